"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import numpy as np
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.batches import per_text, per_value, texts_of

#: What the classifier may learn from: passages per language, of all languages, and their length.
PASSAGES = 600
ALL_PASSAGES = 128 * PASSAGES
PASSAGE_CHARS = 400
#: Texts are compressed in pieces, so that a dictionary matters throughout a long text.
PIECE_BYTES = 1024
LEVEL = 6
#: A best size this close to the next is rejected, unless the text is too short to tell.
NARROW = 0.02
SHORT_BYTES = 64
UNKNOWN = "und"

_OTHER = regex.compile(r"\P{L}+")


def letters(text: str | None) -> bytes:
    """The words (runs of letters) of a whole text in lower case, one space apart."""
    return _OTHER.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


class Languages:
    """Raw-content dictionaries, the most frequent language first."""

    def __init__(self, passages: dict[str, list[str]]):
        self.names = list(passages)
        self.contents = [b" ".join(letters(text) for text in texts) for texts in passages.values()]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in self.contents:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )
        return made

    def classify(self, text: str | None, compressors: list[zstandard.ZstdCompressor]) -> tuple[str, float, bool]:
        """The language of the smallest compressed size, the relative distance of the next, and whether it is rejected."""
        raw = letters(text)
        if not raw or not self.names:
            return UNKNOWN, 0.0, True
        pieces = [raw[at : at + PIECE_BYTES] for at in range(0, len(raw), PIECE_BYTES)]
        sizes = np.array([sum(len(c.compress(piece)) for piece in pieces) for c in compressors])
        order = np.argsort(sizes, kind="stable")
        if len(order) == 1:
            return self.names[0], 1.0, False
        margin = float(1 - sizes[order[0]] / sizes[order[1]])
        return self.names[order[0]], margin, margin < NARROW and len(raw) >= SHORT_BYTES


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def share(counts: list[int], passages: int) -> int:
    """The most passages of a language, 1 at least, with which all together keep to ``ALL_PASSAGES``."""
    left = ALL_PASSAGES
    for place, n in enumerate(sorted(counts)):
        most = left // (len(counts) - place)
        if n > most:
            return max(1, min(passages, most))
        left -= min(n, passages)
    return passages


def learned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", passages: int = PASSAGES
) -> Languages:
    """Dictionaries from ``passages`` documents of each language, chosen by a hash of their ids among all that are not held out.

    Each gives ``PASSAGE_CHARS`` characters from a third of its length on, or its last ones if there are
    fewer; only documents with text count.  Every language is learned; should there be more than ``ALL_PASSAGES``
    passages in all, the languages with the most documents give fewer.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    known = known.where(F.length("text") > 0)
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    counts = [(row.lang, row.n) for row in counts.collect()]
    passages = share([n for _, n in counts], passages)
    # A hash below this bound is expected for twice the passages wanted, so few rows move.
    bounds = docs.sparkSession.createDataFrame(
        [(lang, min(1.0, 2 * passages / n + 40 / n)) for lang, n in counts], "lang string, bound double"
    )
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.withColumn("place", place).join(F.broadcast(bounds), "lang").where(F.col("place") < F.col("bound") * (1 << 30))
    start = F.greatest(F.lit(0), F.least(F.floor(F.length("text") / 3).cast("int"), F.length("text") - PASSAGE_CHARS)) + 1
    chosen = chosen.select("lang", "place", "doc_id", F.substring("text", start, F.lit(PASSAGE_CHARS)).alias("passage"))
    best = Window.partitionBy("lang").orderBy("place", "doc_id", "passage")
    rows = chosen.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= passages).collect()
    texts: dict[str, list[str]] = {lang: [] for lang, _ in counts}
    for row in sorted(rows, key=lambda row: row.nth):
        texts[row.lang].append(row.passage)
    return Languages(texts)


def _classifier(docs: DataFrame, model: Languages):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        compressors = known.compressors()  # of a task, so that their memory goes back after it
        return lambda text: known.classify(text, compressors)

    return make


def accepted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Languages | None = None
) -> DataFrame:
    """The rows of ``docs`` that ``languages`` does not reject, with all their columns and without a shuffle."""
    classifier = _classifier(docs, learned(docs, id_col, text_col, lang_col) if model is None else model)

    def make():
        classify = classifier()
        return lambda text: not classify(text)[2]

    rows = docs.select(F.struct("*").alias("row"), per_value(F.col(text_col), make, "boolean").alias("kept"))
    return rows.where("kept").select("row.*")


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Languages | None = None
) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected`` of every row of ``docs``.

    Each whole text is compressed piece by piece with every language's
    dictionary; the smallest sum wins, a tie goes to the language with more
    learned documents.  ``score`` grows with the distance to the next size, up
    to 1; a distance under 2 % is ``rejected``, unless fewer than 64 bytes of
    letters leave no evidence.  A null text or one without letters is ``und``,
    score 0, rejected.  If nothing can be learned all are.  A null id is neither learned from
    nor held out.  Rows stay as they are, repeated ones too; other columns, ``lang``
    and ``source`` among them, play no part in a prediction.  Nothing is shuffled but the learned passages.
    """
    make = _classifier(docs, learned(docs, id_col, text_col, lang_col) if model is None else model)
    found = per_text(texts_of(docs, id_col, text_col), make, "lang_pred string, margin double, rejected boolean")
    score = F.least(F.lit(1.0), 4 * F.col("margin"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", score.alias("score"), "rejected")
