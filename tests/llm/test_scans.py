"""Quality rules, secrets, toxicity, language, licenses, decontamination."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from llm.helpers import documents, edge_texts, empty, prose
from pyspark.sql import functions as F

from ledgerscope.llm import decontaminate, language, licenses, quality, secrets, toxicity
from ledgerscope.llm.common import crc_remainder, hash_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text: str):
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_rules_against_a_plain_version():
    for t in [*(t or "" for t in edge_texts()), prose(30, 1) + " " + prose(30, 1), "a|b ## " * 9]:
        assert quality.rules(t.encode(), t.encode().split()) == plain_rules(t)


def test_js_distance():
    refs = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert quality.js_distance(np.array([4.0, 0.0]), refs)[0] == 0
    assert quality.js_distance(np.array([0.0, 1.0]), refs)[0] == pytest.approx(1.0)


def test_quality_keeps_prose_and_drops_noise(spark):
    clean = [(i, prose(200, i), "en") for i in range(40)]
    noise = [(100, "".join(random.Random(1).choices("#$%&*|<>", k=900)).replace("", " ") + prose(5, 1), "en"), (101, prose(200, 3).upper().replace(" ", "!! "), "en")]
    docs = spark.createDataFrame(clean + noise, "doc_id long, text string, lang string")
    refs = quality.fit(docs)
    kept = {r["doc_id"] for r in quality.keep(docs, refs).collect()}
    assert kept == set(range(40))
    assert {r["doc_id"] for r in quality.assess(docs, refs).where("kept").collect()} == kept


def test_quality_keeps_small_languages(spark):
    """One language holds nearly all words: a small one keeps its own reference, a tiny one is not judged by others."""
    greek = str.maketrans("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψωϊϋ")
    common = "lorem ipsum dolor sit amet".split()  # half of the small language's words
    rows = [(i, prose(3000, i), "en") for i in range(700)]
    rows += [(1000 + i, " ".join(w for x in prose(100, i).split() for w in (x.translate(greek), common[len(x) % 5])), "el") for i in range(40)]
    rows += [(2000 + i, prose(150, i).translate(greek), "xx") for i in range(5)]
    rows += [(3000, "#$%&* |<>| " * 12 + " ".join(f"{c}#$%&*|<>!{i}" for i, c in enumerate("#$%&*|<>" * 20)), "en"), (3001, "|".join("#$%&*<>" * 60) + " a b c" * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    refs = quality.fit(docs)
    assert refs.langs == ["el", "en"]
    kept = {r["doc_id"] for r in quality.keep(docs, refs).collect()}
    assert kept == {r[0] for r in rows if r[0] < 3000}
    assert {r["doc_id"] for r in quality.assess(docs, refs).where("kept").collect()} == kept


def test_word_distance_equals_the_dense_one():
    rng = np.random.default_rng(3)
    refs = rng.random((6, 50)) * (rng.random((6, 50)) < 0.5)
    refs /= refs.sum(1, keepdims=True)
    for n in (1, 7, 400):
        ids = rng.integers(0, 50, n)
        assert quality.word_distance(ids, refs) == pytest.approx(quality.js_distance(np.bincount(ids, minlength=50), refs))


def test_quality_edges(spark):
    docs = documents(spark)
    refs = quality.fit(docs)
    got = quality.assess(docs, refs)
    assert got.count() == docs.count()
    assert got.where("n_words = 0 and kept").count() == 0
    assert quality.keep(docs, refs).columns == docs.columns
    none = quality.fit(empty(spark))
    assert quality.assess(empty(spark), none).collect() == []
    assert quality.assess(docs, none).where("kept = base_failed").count() == 0


def plain_base(text):
    spans = []
    rx = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans += [(m.start(), 0, m.end()) for m in rx.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_base_spans_against_a_plain_version():
    rng = random.Random(4)
    bits = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", ":", "=", " ", '"', "'", "abcdefgh", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "é", "ſecret", "toKen", "-", "."]
    for _ in range(4000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert secrets.base_spans(t) == plain_base(t), t


def test_markov_finds_random_strings_and_leaves_identifiers(spark):
    docs = spark.createDataFrame([(i, prose(150, i)) for i in range(50)], "doc_id long, text string")
    model = secrets.train(secrets.training_sample(docs))
    held_out = secrets.random_strings(60, seed=99)
    assert np.mean([model.llr(s) >= 20 for s in held_out]) > 0.8  # short ones stay below the limit
    ordinary = ["_".join(prose(4, s).split()) for s in range(100, 160)] + [w for s in range(60) for w in prose(20, s).split()]
    assert not any(model.llr(s) >= 20 and model.llr(s) >= 0.8 * len(s) for s in ordinary if len(s) >= 20)


def test_secret_scan_and_redaction(spark):
    docs = documents(spark)
    model = secrets.train(secrets.training_sample(docs))
    got = secrets.scan(docs, model).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        base = plain_base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(filter(None, secrets.joined(base).split(","))) <= set(r["spans"].split(","))
    clean = secrets.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for r in clean.collect():
        before = texts[r["doc_id"]]
        assert r["text"] == before or not plain_base(r["text"])
        assert not plain_base(before or "") or "[secret]" in r["text"]
    assert secrets.scan(empty(spark), model).collect() == []
    assert secrets.redacted("abcdef", [(1, 0, 3), (2, 2, 4)], "*") == "a*ef"


def test_clause_grammar():
    model = toxicity.ToxicityModel({"idiot": 2.0, "low*": 3.0})

    def score(text):
        return toxicity.document_features(text, model, {})[1]

    assert score("a fine day") == 0
    assert score("what an idiot") == 2.0
    assert score("you are an idiot") > score("what an idiot")
    assert score("not an idiot") < score("what an idiot")
    assert score("they said what an idiot") < score("what an idiot")
    assert score("lowlife") == 3.0 and score("low") == 0
    assert score("I will kill you") > 0 and score("kill the lights") == 0


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words, bad = prose(80, i).split(), i % 4 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilus", "grumbe", "zokkan" + rng.choice(["s", "t", "er"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (5000, 1), (None, 1), (901, None)], "doc_id long, toxic int")
    rest = crc_remainder("doc_id", 5)
    got = toxicity.score(docs, toxicity.fit(docs, labels, rest != 0), rest == 0)
    assert got.count() == 403 and got.where("score is null or score < 0 or score > 1").count() == 0
    held = [(r["predicted"], r["toxic"]) for r in got.where("held_out").join(labels, "doc_id").collect()]
    assert len(held) > 30 and np.mean([p == y for p, y in held]) > 0.95
    blank = toxicity.fit(docs, labels.where("false"), rest != 0)
    assert toxicity.score(docs, blank, rest == 0).where("predicted = 1").count() == 0


def test_language_held_out(spark):
    sets = {"aa": "an er ti on th".split(), "bb": "ou le mo ui qu".split()}
    rows = []
    for i in range(300):
        lang = "aa" if i % 2 else "bb"
        rng = random.Random(i)
        rows.append((i, " ".join("".join(rng.choices(sets[lang], k=rng.randint(1, 4))) for _ in range(25)), lang if i % 7 else None))
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "12 34 !!", "aa")], "doc_id long, text string, lang string")
    rest = crc_remainder("doc_id", 4)
    model = language.fit(docs, rest != 2)
    got = {r["doc_id"]: r for r in language.predict(docs, model, rest == 2).collect()}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    held = [got[i]["lang_pred"] == ("aa" if i % 2 else "bb") for i in range(300) if got[i]["held_out"]]
    assert len(held) > 40 and np.mean(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    blank = language.fit(docs.where("false"), rest != 2)
    assert {r["lang_pred"] for r in language.predict(docs, blank, rest == 2).collect()} == {"und"}


def test_language_letters_and_edges(spark):
    assert language.letter_runs("½ ② Ⅷ 3rd x²y été 中文 a_b") == ["rd", "x", "y", "été", "中文", "a", "b"]
    schema = "doc_id long, text string, lang string, words string, rows string, held_out string"
    rows = [(i, "the cat sat" if i % 2 else "le chat dort", "en" if i % 2 else "fr", "w", "r", "h") for i in range(40)]
    rows += [(100, "½ ② Ⅷ 12", None, "w", "r", "h"), (101, "", "en", "w", "r", "h"), (102, "the le", None, "w", "r", "h"), (103, "the cat sat " * 60_000, None, "w", "r", "h")]
    rows += [rows[1], (None, "le chat", None, "w", "r", "h")]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    held = F.col("doc_id") % 4 == 2
    got = language.predict(docs, language.fit(docs, ~held), held).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[100]["lang_pred"] == by[101]["lang_pred"] == "und" and by[100]["score"] == 0
    assert by[102]["lang_pred"] in ("en", "fr") and by[103]["lang_pred"] == "en" and by[None]["lang_pred"] == "fr"
    assert sum(r["doc_id"] == 1 for r in got) == 2
    few = language.fit(docs.where("doc_id < 2"), F.lit(True), min_count=50)  # languages without a known item: a tie
    assert {r["lang_pred"] for r in language.predict(docs, few, held).collect()} == {"en", "und"}
    assert language.predict(docs.where("false"), few, held).collect() == []


def test_unseen_words_back_off_to_shorter_grams():
    m = language.LanguageModel(["a", "b"], {"the": 0}, np.array([[0.0, -9.0]]), {" th": 0, "x": 1}, np.array([[-1.0, -5.0], [-3.0, -2.0]]), 4)
    assert m.word_scores("the").tolist() == [0.0, -9.0]
    assert m.word_scores("thx").tolist() == [-4.0, -7.0]


def test_licenses(spark):
    lines = {"MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "licensed under CC BY-NC 4.0"}
    rows, want = [], {}
    for i in range(200):
        name = [*lines, None][i % 4]
        text = prose(30, i) + ("\n" + lines[name] if name else "") + (" " + prose(9, i + 1) if i % 3 else "")
        rows.append((i, text))
        want[i] = name or ""
    rows += [(900, None), (901, ""), (902, "the MIT License"), (None, lines["MIT"]), (903, lines["MIT"]), (903, lines["MIT"])]
    want |= {900: "", 901: "", 902: "", None: "MIT", 903: "MIT"}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(docs, licenses.templates(spark))
    assert {r["doc_id"]: r["licenses"] for r in got.collect()} == want
    assert licenses.scan(docs.where("false"), licenses.templates(spark)).collect() == []
    assert licenses.miss_probability() < 1e-5
    with pytest.raises(ValueError):
        licenses.find(docs, spark.createDataFrame([("x", "too short")], "license string, text string"))


def test_full_license_texts(spark):
    """Headers and full texts, from files and rewrapped as comments, with a changed word, and two in one document."""
    rows, want = [], {}
    for i, f in enumerate(sorted(licenses.TEXTS.glob("*.txt"))):
        text = f.read_text(encoding="utf-8")
        words = text.split()
        words[len(words) // 2] = "changed"
        for k, t in enumerate([text, "// " + text.replace("\n", "\n// "), " ".join(words)]):
            rows.append((10 * i + k, prose(37 + i, i) + "\n" + t + "\n" + prose(60, i + 1)))
            want[10 * i + k] = f.name.rsplit(".", 2)[0]
    texts = {f.name: f.read_text(encoding="utf-8") for f in licenses.TEXTS.glob("*.txt")}
    rows += [(9000, texts["GPL-2.0.header.txt"] + prose(50, 1) + " " + texts["GPL-3.0.header.txt"]), (9001, texts["MIT.full.txt"] + prose(9, 1) + " " + texts["Apache-2.0.header.txt"])]
    want |= {9000: "GPL-2.0,GPL-3.0", 9001: "Apache-2.0,MIT"}
    for i, (name, text) in enumerate(licenses.cc_notices()):
        rows.append((9100 + i, prose(20, i) + "\n" + text + "\n" + prose(20, i + 1)))
        want[9100 + i] = name
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(docs, licenses.templates(spark))
    found = {r["doc_id"]: r["licenses"] for r in got.collect()}
    assert {k: (v, found[k]) for k, v in want.items() if v != found[k]} == {}


def test_license_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = licenses.scan(docs, licenses.templates(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def items(n):
    return [(i, prose(20 + i % 30, 1000 + i) + ". " + prose(6 + i % 5, 2000 + i) + ".") for i in range(n)]


def test_wand_equals_a_full_scan():
    index = decontaminate.Bm25Index(items(80), 0.2, 64)
    wand = decontaminate.BlockMaxWand(index)
    for seed in range(60):
        query = set(prose(60, 1000 + seed).split())
        scores = collections.Counter()
        for w in query:
            for block in index.lists.get(w, []):
                for item, x in zip(block.items, block.impacts, strict=True):
                    scores[item] += x
        want = sorted(i for i, s in scores.items() if s >= index.thresholds[i])
        assert wand.search(query) == want
        assert wand.search(query, [i for i in want if i % 2]) == [i for i in want if i % 2]


def test_decontamination_against_a_full_comparison(spark):
    bench, rng, rows = items(60), random.Random(6), []
    for i in range(150):
        words = prose(rng.randint(0, 400), i).split()
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = bench[i % 60][1].split()
        elif i % 3 == 1:  # the question without its answer, or a few words of it
            words += bench[i % 60][1].split()[: 12 if i % 2 else 15]
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, bench[3][1]), (None, bench[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([*bench, (70, None), (71, ""), (None, "x")], "item_id long, text string")
    want = set()
    for d, t in rows:
        words = decontaminate.words_of(t or "")
        for item, text in bench:
            parts = [decontaminate.shingle_set(p) for p in decontaminate.parts_of(text)]
            own = {tuple(words[k : k + s]) for p in parts for s in {len(next(iter(p)))} for k in range(len(words) - s + 1)}
            if all(len(p & own) / len(p) >= 0.6 for p in parts):
                want.add((d, item))
    for most in (20_000, 25):  # one index, and shards
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, table, max_items=most).collect()}
        assert got == want
    kept = decontaminate.keep(docs, table)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert kept.columns == docs.columns
    assert decontaminate.find(docs, table.where("false")).collect() == []


def test_decontamination_finds_near_copies(spark):
    """Copies with one changed word anywhere, and questions without the answer, for items of many shapes."""
    bench = [(i, prose(q, 1000 + i).replace(".", "") + ". " + prose(a, 2000 + i).replace(".", "") + ".") for i, (q, a) in enumerate([(6, 3), (8, 5), (10, 10), (20, 5), (25, 12), (40, 8), (16, 30), (5, 4)])]
    rows, want, at = [], set(), 0
    for i, text in bench:
        words = text.split()
        for k in range(len(words)):
            copy = [*words[:k], "changed" + words[k][-1:] * words[k].endswith("."), *words[k + 1 :]]
            rows.append((at, prose(60, at) + " " + " ".join(copy) + " " + prose(60, at + 1)))
            want.add((at, i))
            at += 1
        question = text.split(". ")[0]
        if len(question.split()) > 12:
            rows.append((at, prose(60, at) + " " + question + ". " + prose(60, at + 1)))
            want.add((at, i))
            at += 1
    rows += [(10_000 + k, prose(300, 50_000 + k)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.find(docs, table).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert (want - got, got - want) == (set(), set())
    assert {r["doc_id"] for r in decontaminate.keep(docs, table).collect()} == {d for d, _ in rows if d >= 10_000}


def test_decontamination_normalises_a_word_once(monkeypatch):
    """However many passages hold it; forms are those of ``words_of``."""
    index = decontaminate.Bm25Index([*items(60), (90, "\u0391\u03a3 don't stop. Stra\u00dfe \u0130x sum_ it up.")], 0.5, 128)
    scanner = decontaminate.Scanner(index, 128, 0.6)
    odd = "\u0391\u03a3 DON'T (stop), STRASSE Stra\u00dfe. \u0130X ... \u00ab \u0391\u03a3' _it_ sum_ 'sum_' x\x1cup\u00a0It, --"
    known = [index.names[i] if i >= 0 else "" for i in scanner._word_ids(odd.lower().split()) if i != decontaminate.EMPTY]
    assert known == [w if w in index.word_id else "" for w in decontaminate.words_of(odd)]
    text = " ".join(t + " " + prose(100, k) for k, t in items(60))
    calls, normal = [], decontaminate.normal
    monkeypatch.setattr(decontaminate, "normal", lambda w: calls.append(w) or normal(w))
    found = scanner.scan([text, text, odd])
    assert [m[0] for m in found[0]] == list(range(60)) and found[1] == found[0]
    assert len(calls) <= len({w.lower() for w in text.split() + odd.split()})


def test_hash_sample_is_bounded_and_repeats(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"] for r in hash_sample(df, "doc_id", 1000).collect()}
    assert 800 < len(got) < 1200
    assert got == {r["doc_id"] for r in hash_sample(df.repartition(7), "doc_id", 1000).collect()}
    assert hash_sample(df, "doc_id", 50_000).count() == 20_000


def test_crc_remainder_is_that_of_the_id_as_text(spark):
    import zlib

    got = spark.range(50).select("id", crc_remainder("id", 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
    assert spark.range(1).select(crc_remainder(F.lit(None).cast("long"), 5).alias("r")).first()["r"] is None
