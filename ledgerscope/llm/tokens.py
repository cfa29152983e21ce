"""Exact token ids and counts of a byte-level BPE tokenizer, by looking up text units.

A text is cut into units: a word with the one space or line break before it.
Byte-level pre-tokenization never joins characters across such a cut, so the
ids of a text are the ids of its units in order (``units_of`` merges what
stands at any other white space into one unit).  Special strings contain no
space, so they stay inside a unit and the library treats them as in the whole
text.

Two tiers answer a unit: a broadcast table of frequent units, then a cache in
the Python worker; what neither has goes to the library in batches.  No unit
is ever shuffled.  The table is fitted on a bounded hash sample of documents
(``sample_docs``, at most ``table_size`` entries) and only decides which tier
answers, never the result.  A worker cache holds at most ``cache_size`` units
of at most ``longest`` characters and is emptied when full.

Defined cases: null or empty text has no tokens; repeated rows and ids are
answered row by row.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import hash_sample, id_and_text, map_batches, worker_state

#: The split that byte-level pre-tokenization makes before its merges (fixed by the file format).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_SPACE = 100_000  # white-space characters in a row that are looked for


def _long_space(text: str) -> bool:
    """Whether an aligned piece of ``LONG_SPACE`` characters is white space, as in any run of twice as many."""
    return any(text[i : i + LONG_SPACE].isspace() for i in range(0, len(text) - LONG_SPACE + 1, LONG_SPACE))


class Encoder:
    """Byte-level BPE of a ``tokenizers`` JSON file.

    Long runs of text go through ``tiktoken`` with the vocabulary of the same
    file, several times faster than the JSON library on one core; the tests
    hold both equal over all code points, random strings, long runs and the
    documents.  Its split pattern backtracks over white space and fails on runs
    of about a million characters; texts with such a run (``_long_space``) go to
    the JSON library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Byte-level vocabularies write each byte as one printable character.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        self._path, self._library = path, None
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._coder = tiktoken.Encoding("bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._n_bytes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for t, i in ranks.items():
            self._n_bytes[i] = len(t)
        for t, i in special.items():
            self._n_bytes[i] = len(t.encode())

    def ids(self, text: str) -> np.ndarray:
        if _long_space(text):
            if self._library is None:
                import tokenizers

                self._library = tokenizers.Tokenizer.from_file(self._path)
            return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self._coder.encode_to_numpy(text, allowed_special="all")

    def joined(self, units: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all units through one call and where each one's end; None if the units are not ``plain``, each with its space or line break."""
        if not plain and any(u[:1] not in (" ", "\n") or not _plain(u[u[:1] == " " :]) for u in units):
            return None
        ids = self.ids("".join(units))
        ends = np.cumsum(np.fromiter((len(u) if u.isascii() else len(u.encode()) for u in units), np.int64, len(units)))
        return ids, np.searchsorted(np.cumsum(self._n_bytes[ids]), ends, side="left") + 1

    def each(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit by itself."""
        found = self.joined(units) if units else None
        return [self.ids(u) for u in units] if found is None else np.split(found[0], found[1][:-1])

    def packed(self, units: list[str], plain: bool = False) -> list[bytes]:
        """Ids of each unit by itself, as little-endian 32-bit integers."""
        found = self.joined(units, plain)
        if found is None:
            return [self.ids(u).astype("<u4").tobytes() for u in units]
        data, ends = found[0].astype("<u4").tobytes(), (4 * found[1]).tolist()
        return [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def counted(self, units: list[str], plain: bool = False) -> list[int]:
        """Number of ids of each unit by itself."""
        found = self.joined(units, plain)
        return [len(self.ids(u)) for u in units] if found is None else np.diff(found[1], prepend=0).tolist()


def units_of(text: str) -> list[str]:
    """Units of a text in any white space; their concatenation is the text."""
    parts = text.replace("\n", " \n").split(" ")
    out, cur = [], parts[0]
    for p in parts[1:]:
        piece, head = (p, p[1:2]) if p[:1] == "\n" else (" " + p, p[:1])
        if cur and not cur[-1].isspace() and head and not head.isspace():
            out.append(cur)
            cur = piece
        else:
            cur += piece
    return [*out, cur] if cur else out


def _plain(part: str) -> bool:
    """Whether a part cut at spaces is a unit by itself, whatever its (plain) neighbours are."""
    body = part[1:] if part[:1] == "\n" else part
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


class Generations:
    """A bounded cache: entries not asked for while ``size`` others come in are forgotten."""

    def __init__(self, size: int, longest: int, fixed: dict | None = None):
        self.size, self.longest, self.fixed = size, longest, fixed or {}
        self.young: dict[str, object] = dict(self.fixed)
        self.old: dict[str, object] = {}

    def get(self, keys: list[str]) -> tuple[list, list[str]]:
        """Values in order (None: missing), and the missing keys once each."""
        values = list(map(self.young.get, keys))
        if None not in values:
            return values, []
        at = [i for i, v in enumerate(values) if v is None]
        old, missing = self.old, {}
        for i in at:
            k = keys[i]
            v = old.get(k)
            if v is None:
                missing[k] = None
            else:
                values[i] = v
                if len(k) <= self.longest:
                    self.young[k] = v
        return values, list(missing)

    def put(self, found: dict[str, object]) -> None:
        self.young.update((k, v) for k, v in found.items() if len(k) <= self.longest)
        if len(self.young) > self.size + len(self.fixed):
            self.old, self.young = self.young, dict(self.fixed)


class UnitCache:
    """Values of units: ``inner`` by the part after the space (or with its line break), ``literal`` by the unit itself."""

    def __init__(self, path: str, as_bytes: bool, table: dict | None, cache_size: int, longest: int):
        self.encoder, self.as_bytes = Encoder(path), as_bytes
        self.inner = Generations(cache_size, longest, table)
        self.literal = Generations(cache_size // 4, longest)

    def _fill(self, cache: Generations, keys: list[str], values: list, missing: list[str], units: list[str], plain: bool) -> list:
        if missing:
            encode = self.encoder.packed if self.as_bytes else self.encoder.counted
            found = dict(zip(missing, encode(units, plain), strict=True))
            values = [found[k] if v is None else v for k, v in zip(keys, values, strict=True)]
            cache.put(found)
        return values

    def _literal(self, units: list[str]) -> list:
        values, missing = self.literal.get(units)
        return self._fill(self.literal, units, values, missing, missing, False)

    def lookup(self, texts: list[str]) -> list[list]:
        """For each text, the values of its units in order."""
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        odd = {k for k, s in enumerate(split) if len(s) > 1 and (not s[0] or s[0][-1].isspace())}
        flat = [p for k, s in enumerate(split) if k not in odd for p in islice(s, 1, None)]
        values, missing = self.inner.get(flat)
        bad = {p for p in missing if not _plain(p)}
        if bad:
            odd |= {k for k, s in enumerate(split) if k not in odd and not bad.isdisjoint(s[1:])}
            flat = [p for k, s in enumerate(split) if k not in odd for p in islice(s, 1, None)]
            values, missing = self.inner.get(flat)
        values = self._fill(self.inner, flat, values, missing, [p if p[0] == "\n" else " " + p for p in missing], True)
        firsts = dict(zip(whole := [k for k in range(len(texts)) if k not in odd], self._literal([split[k][0] for k in whole]), strict=True))
        out, at = [], 0
        for k, s in enumerate(split):
            if k in odd:
                out.append(self._literal(units_of(texts[k])))
            else:
                out.append([firsts[k], *values[at : at + len(s) - 1]])
                at += len(s) - 1
        return out


def _cache(path: str, as_bytes: bool, table, cache_size: int, longest: int) -> UnitCache:
    def make() -> UnitCache:
        return UnitCache(path, as_bytes, table.value if table is not None else None, cache_size, longest)

    return worker_state(f"units:{as_bytes}:{cache_size}:{path}", make)


def frequent_units(
    docs: DataFrame, path: str, sample_docs: int = 2000, table_size: int = 50_000, longest: int = 64, as_bytes: bool = False
) -> dict[str, int] | dict[str, bytes]:
    """Token counts, or packed ids, of the most frequent plain units of a bounded sample; at most ``table_size`` entries.

    Only a bounded number of rows is counted: the sample's units are summed
    per map task before they are shuffled.
    """

    def count(cols):
        c = Counter(chain.from_iterable(t.replace("\n", " \n").split(" ")[1:] for t in cols["text"]))
        keep = [(u, n) for u, n in c.items() if n > 1 and _plain(u) and len(u) <= longest]
        return {"unit": [u for u, _ in keep], "n": [n for _, n in keep]}

    sample = hash_sample(id_and_text(docs), "doc_id", sample_docs).select("text")
    rows = map_batches(sample, count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(table_size).collect()
    names = [r["unit"] for r in rows]
    encoded = Encoder(path).each([u if u[0] == "\n" else " " + u for u in names]) if names else []
    return dict(zip(names, (x.astype("<u4").tobytes() if as_bytes else len(x) for x in encoded), strict=True))


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
    cache_size: int = 100_000, longest: int = 64, sample_docs: int = 2000, table_size: int = 50_000,
) -> DataFrame:
    """One row per document: ``n_bytes``, ``n_tokens`` and whether ``n_tokens`` exceeds ``limit``."""
    texts = id_and_text(docs, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent_units(texts, path, sample_docs, table_size, longest))

    def batch(cols):
        cache = _cache(path, False, table, cache_size, longest)
        counts = []
        for at in range(0, len(cols["text"]), 256):
            counts += map(sum, cache.lookup(cols["text"][at : at + 256]))
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in cols["text"]], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_batches(texts, batch, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def token_bytes(texts: list[str], path: str, table=None, cache_size: int = 200_000, longest: int = 64) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; ``table``: broadcast frequent units with packed ids."""
    cache = _cache(path, True, table, cache_size, longest)
    out = []
    for at in range(0, len(texts), 256):
        out += map(b"".join, cache.lookup(texts[at : at + 256]))
    return out
