"""Dictionary terms: every literal occurrence of every listed term."""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.patterns import column_name, sql_string
from veilframe.functions.rules import DICTIONARY_CONFIDENCE, DICTIONARY_DETECTOR
from veilframe.functions.spans import DICTIONARY_PLACE, SPANS_TYPE, blocks_of, priority_sql, text_of
from veilframe.operators.skew import join_skewed
from veilframe.operators.tokens import union_of
from veilframe.session import staged
from veilframe.sources.policies import Policy

# Term lists up to this many characters (16 more for each term) travel to every task: each Python worker of an executor builds
# its own automaton, which takes some hundred bytes a character where terms share no beginning.
BROADCAST_CHARS = 2 * 1024 * 1024
#: Texts are looked at together until they have this many characters.
GROUP_CHARS = 1 << 20
#: The table of marks for larger lists has at most this many bits, as a power of two, and at least so many for each term: it
#: lets at most (4 / 32)^2 of all places through for nothing.  Longer lists are looked for slice by slice.
MOST_MARK_BITS = 27
BITS_PER_TERM = 32
# Powers are worked out for so many places at once.
BLOCK = 1 << 16


def distinct_terms(terms: DataFrame) -> DataFrame:
    """``(term_ord, term, entity_type)`` without repeated pairs, which could
    only find their own spans again."""
    return (
        terms.where(F.length("term") > 0)
        .groupBy("term", "entity_type")
        .agg(F.min("term_ord").alias("term_ord"))
        .select("term_ord", "term", "entity_type")
    )


def term_chars(terms: DataFrame) -> int:
    """Size of a term list, for the choice of plan."""
    return terms.agg(F.coalesce(F.sum(F.length("term") + 16), F.lit(0)).alias("n")).first()["n"]


def _finder(terms: list[str]):
    """A function from a text to its non-overlapping hits, term by term."""
    automaton = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        automaton.add_word(term, number)
    automaton.make_automaton()

    def search(text: str):
        for last, number in automaton.iter(text):
            yield number, last - len(terms[number]) + 1

    def find(text: str | None) -> list[tuple[int, int, int]]:
        hits = []
        free_from: dict[int, int] = {}
        for number, start in search(text or ""):
            if start >= free_from.get(number, 0):
                free_from[number] = start + len(terms[number])
                hits.append((number, start, start + len(terms[number])))
        return sorted(hits)

    return find


def _with_broadcast_spans(
    docs: DataFrame, terms: DataFrame, policy: Policy, text: str = "text", output: str = "_terms"
) -> DataFrame:
    """Add the dictionary spans of every document as an array column, for lists that ``add_term_spans`` finds small enough.

    One pass over each text finds all terms at once; the terms go to the tasks
    as a broadcast variable (they never appear in a plan) and the texts stay
    where they are.
    """
    rows = sorted((r.term_ord, r.term, r.entity_type) for r in distinct_terms(terms).collect())
    names = list(dict.fromkeys(term for _, term, _ in rows))
    uses: dict[str, list[tuple[int, str]]] = {}
    for order, term, entity in rows:
        uses.setdefault(term, []).append((order, entity))
    shared = docs.sparkSession.sparkContext.broadcast((names, [uses[name] for name in names]))

    @F.pandas_udf("array<struct<start:int,end:int,term_ord:bigint,entity_type:string,value:string>>")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        listed, entries = shared.value
        find = _finder(listed)
        for batch in texts:
            yield batch.map(
                lambda one: [
                    {"start": start, "end": end, "term_ord": order, "entity_type": entity, "value": listed[number]}
                    for number, start, end in find(one)
                    for order, entity in entries[number]
                ]
            )

    found = docs.withColumn("_hits", hits(F.expr(text_of(text))))
    return found.withColumn(output, _as_spans("_hits", policy)).drop("_hits")


def _as_spans(hits: str, policy: Policy) -> Column:
    """Hits to full spans, ordered by term, then by place in the text."""
    other = sql_string(policy.default_action)
    actions = " ".join(
        f"when {sql_string(name)} then {sql_string(policy.action_for(name))}" for name in policy.entity_types()
    )
    action = f"case h.entity_type {actions} else {other} end" if actions else other
    ordered = f"""transform(array_sort(transform({hits}, h -> named_struct('o', h.term_ord, 's', h.start, 'h', h))), k -> k.h)"""
    return F.expr(f"""transform({ordered}, h -> named_struct(
        'start', h.start, 'end', h.end, 'entity_type', h.entity_type, 'action', {action},
        'confidence', {DICTIONARY_CONFIDENCE}D, 'priority', {priority_sql('h.entity_type')}, 'place', {DICTIONARY_PLACE},
        'detector', '{DICTIONARY_DETECTOR}', 'risk', 'medium', 'value', h.value))""").cast(SPANS_TYPE)


# --- term lists of any size ---------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


_BACK = pow(int(_BASE), -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(count, base, np.uint64)])


_UP, _DOWN = _powers(int(_BASE), BLOCK - 1), _powers(_BACK, BLOCK - 1)


def _power_of(places: np.ndarray, base: int, near: np.ndarray) -> np.ndarray:
    """Powers of a base at any places: of the place's block times of the place in it."""
    blocks = np.array([pow(base, BLOCK * n, 1 << 64) for n in range(int(places.max(initial=0)) // BLOCK + 1)], np.uint64)
    return blocks[places // BLOCK] * near[places % BLOCK]


class Rolling:
    """Hashes of all parts of a text: running sums of its characters times powers of an odd number, modulo 2^64."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        for start in range(0, len(codes), BLOCK):
            part = codes[start : start + BLOCK].astype(np.uint64) + np.uint64(1)
            part *= _UP[: len(part)] * np.uint64(pow(int(_BASE), start, 1 << 64))
            self.sums[start + 1 : start + 1 + len(part)] = np.cumsum(part) + self.sums[start]

    def plain(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * _power_of(starts, _BACK, _DOWN)

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        mixed = self.plain(starts, starts + length) + np.uint64(length * int(_MIX) & (1 << 64) - 1)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        return mixed ^ (mixed >> np.uint64(29))


def overlaps_itself(term: str) -> bool:
    """Whether a term begins as it ends, so that two of its places can overlap."""
    rolling, size = Rolling(_codes(term)), len(term)
    lengths = np.arange(1, size)
    alike = rolling.plain(np.zeros_like(lengths), lengths) == rolling.plain(size - lengths, np.full_like(lengths, size))
    return any(term.startswith(term[-length:]) for length in lengths[alike].tolist())


def head_length(length: int) -> int:
    """Terms are told by their first characters: as many as the largest power of two up to their length."""
    return 1 << (length.bit_length() - 1)


def _marks(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places in a table of 2^bits marks for each hash."""
    return [(hashes >> np.uint64(64 - bits)).astype(np.int64), (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)]


def _set(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    one, two = _marks(hashes, bits)
    seen = table[one >> 3] >> (one & 7).astype(np.uint8) & 1
    return (seen & table[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def term_marks(terms: DataFrame, bits: int) -> np.ndarray:
    """A table with the marks of all terms and of their heads.  Its size is bounded whatever the list: where that is too
    small for the list, more places are looked at in vain."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.array([], np.int64)]
            for term in batch.column(0).to_pylist():
                rolling, start = Rolling(_codes(term)), np.zeros(1, np.int64)
                for length in (head_length(len(term)), len(term)):
                    places += _marks(rolling.of(start, length), bits)
            at = np.unique(np.concatenate(places))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(1 << (at & 31))], ["word", "mark"])

    words = terms.select("term").mapInArrow(marked, "word long, mark long").groupBy("word").agg(F.bit_or("mark").alias("marks"))
    table = np.zeros(1 << max(0, bits - 5), "<u4")
    found = words.toArrow()
    table[found.column("word").to_numpy()] = found.column("marks").to_numpy()
    return table.view(np.uint8)


class Places:
    """Looks for parts of texts that may be terms, many texts at once."""

    def __init__(self, marks: np.ndarray, bits: int, lengths: list[int]):
        self.marks, self.bits = marks, bits
        self.heads: dict[int, list[int]] = {}
        for length in sorted(lengths):
            self.heads.setdefault(head_length(length), []).append(length)

    def of(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """Number of the text, start and length of each such part."""
        sizes = np.array([len(text) for text in texts])
        ends = np.cumsum(sizes)
        codes = _codes("".join(texts))
        rolling = Rolling(codes)
        left = np.repeat(ends, sizes) - np.arange(len(codes))
        for head, lengths in self.heads.items():
            starts = np.flatnonzero(left >= head)
            starts = starts[_set(self.marks, rolling.of(starts, head), self.bits)]
            for length in lengths:
                fit = starts[left[starts] >= length]
                if length != head:
                    fit = fit[_set(self.marks, rolling.of(fit, length), self.bits)]
                numbers = np.searchsorted(ends, fit, side="right")
                yield from zip(numbers.tolist(), (fit - (ends - sizes)[numbers]).tolist(), itertools.repeat(length))


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbours of together hardly more than GROUP_CHARS characters, and the number of the first."""
    first, held, size = 0, [], 0
    for number, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield first, held
            first, held, size = number + 1, [], 0
    if held:
        yield first, held


def term_findings(docs: DataFrame, terms: DataFrame, text: str = "text", key: str = "source_id") -> DataFrame:
    """Occurrences by equi-join, for term lists of any size.

    Each task hashes the parts of its texts that are as long as some term and
    looks them up in a broadcast table of marks (16 MB at most): first the head, and only behind a known head the whole
    length.  One running sum over many texts gives all hashes, whatever their length.  What passes is sent on as place and digest of the part, and meets
    the terms by digest.  So neither texts nor windows move; popular terms are
    split by ``join_skewed``.  The digests are salted for each call, as they are staged.  Lists too long for one table are cut into
    slices by a hash of the term, and the texts are read for each.
    """
    terms = distinct_terms(terms)
    shape = terms.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.length("term"))).alias("lengths")).first()
    slices = -(-shape.n * BITS_PER_TERM >> MOST_MARK_BITS) or 1
    if slices == 1:
        return _findings(docs, terms, shape.n, shape.lengths, text, key)
    own = F.pmod(F.xxhash64("term"), F.lit(slices))
    return union_of([_findings(docs, terms.where(own == n), shape.n // slices, shape.lengths, text, key) for n in range(slices)])


def _findings(docs: DataFrame, terms: DataFrame, number: int, lengths: list[int], text: str, key: str) -> DataFrame:
    spark = docs.sparkSession
    bits = min(max(12, (BITS_PER_TERM * (number or 1) - 1).bit_length()), MOST_MARK_BITS)
    shared = spark.sparkContext.broadcast(term_marks(terms, bits))
    salt = uuid.uuid4().hex

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = Places(shared.value, bits, lengths)
        salted = hashlib.sha256(salt.encode())

        def digest(part: str) -> bytes:
            own = salted.copy()
            own.update(part.encode("utf-8", "replace"))
            return own.digest()

        for batch in batches:
            for first, texts in _groups(batch.column(1).to_pylist()):
                rows = [(first + n, at, at + size, digest(texts[n][at : at + size])) for n, at, size in looked.of(texts)]
                numbers, starts, ends, digests = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(numbers, pa.int64())),
                        pa.array(starts, pa.int32()),
                        pa.array(ends, pa.int32()),
                        pa.array(digests, pa.binary()),
                    ],
                    [key, "start", "end", "digest"],
                )

    def knotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("knotted", pa.array([overlaps_itself(term) for term in batch.column(1).to_pylist()], pa.bool_()))

    keyed = docs.select(F.col(key), F.expr(text_of(text)).alias("text"))
    key_type = keyed.schema[key].dataType.simpleString()
    passed = keyed.mapInArrow(found, f"{column_name(key)} {key_type}, start int, end int, digest binary")
    passed = staged(passed, "places")
    uses = staged(passed.groupBy("digest").agg(F.count(F.lit(1)).alias("uses")), "uses")
    entries = F.collect_list(F.struct("term_ord", "entity_type", F.col("term").alias("value"), "knotted"))
    digest = F.unhex(F.sha2(F.concat(F.lit(salt), "term"), 256))
    told = terms.select("term_ord", "term", "entity_type").mapInArrow(knotted, "term_ord bigint, term string, entity_type string, knotted boolean")
    listed = told.withColumn("digest", digest).groupBy("digest").agg(entries.alias("entries")).join(uses, "digest")
    hits = join_skewed(passed, listed, ["digest"], "uses", [key, "start"], uses)
    shown = (key, "start", "end", "term_ord", "entity_type", "value")
    hits = hits.select(key, "start", "end", F.inline("entries"))
    # A term that can overlap itself keeps its leftmost occurrences only.
    loose = hits.where("not knotted").select(*shown)
    chains = (
        hits.where("knotted")
        .groupBy(key, "term_ord", "entity_type", "value")
        .agg(F.array_sort(F.collect_list("start")).alias("starts"))
        .withColumn(
            "starts",
            F.expr(f"""flatten(aggregate({blocks_of('starts')},
                named_struct('free', 0, 'out', cast(array() as array<array<int>>)),
                (done, blk) -> transform(array(aggregate(blk,
                    named_struct('free', done.free, 'out', cast(array() as array<int>)),
                    (acc, s) -> if(s >= acc.free,
                        named_struct('free', s + length(value), 'out', concat(acc.out, array(s))), acc))),
                    r -> named_struct('free', r.free, 'out', concat(done.out, array(r.out))))[0],
                done -> done.out))"""),
        )
        .select(key, "term_ord", "entity_type", "value", F.explode("starts").alias("start"))
        .select(key, "start", (F.col("start") + F.length("value")).cast("int").alias("end"), "term_ord", "entity_type", "value")
    )
    return loose.unionByName(chains)


def with_joined_term_spans(
    docs: DataFrame, terms: DataFrame, policy: Policy, text: str = "text", key: str = "source_id", output: str = "_terms"
) -> DataFrame:
    """The same by way of the join.  Spans return to their
    documents by key, which shuffles the texts once."""
    hits = term_findings(docs, terms, text, key)
    arrays = hits.groupBy(key).agg(
        F.collect_list(F.struct("start", "end", "term_ord", "entity_type", "value")).alias("_hits")
    )
    joined = docs.join(arrays, key, "left").withColumn("_hits", F.coalesce("_hits", F.array()))
    return joined.withColumn(output, _as_spans("_hits", policy)).drop("_hits")


def add_term_spans(docs: DataFrame, terms: DataFrame, policy: Policy, text: str = "text", key: str = "source_id") -> DataFrame:
    """Dictionary spans by the plan that fits the size of the term list."""
    if term_chars(terms) <= BROADCAST_CHARS:
        return _with_broadcast_spans(docs, terms, policy, text)
    return with_joined_term_spans(docs, terms, policy, text, key)
