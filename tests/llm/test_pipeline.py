import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_exact import normal
from test_mixing import plain_mix, size_of
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

from veilframe.llm import language

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_every_stage_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, 0
    first = rows_of(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "simhash", "mixing", "bpe"]

    def step():
        nonlocal docs, at
        _, stage = corpus_pipeline.STAGES[at]
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(at)))
        docs, at = spark.read.parquet(str(tmp_path / str(at))), at + 1
        return docs

    rejected = Counter(r.doc_id for r in language.languages(docs).collect() if r.rejected)
    kept = rows_of(step())
    assert Counter(kept) == Counter(r for r in first if r[0] not in rejected)

    last = {}
    for doc_id, text, _ in kept:
        last[normal(text)] = max(doc_id, last.get(normal(text), doc_id))
    expected = [r for r in kept if last[normal(r[1])] == r[0]]
    kept = rows_of(step())
    assert Counter(kept) == Counter(expected) and len(kept) < len(first)

    roots = plain_components([r[0] for r in kept], [plain_fingerprint(r[1]) for r in kept], 2)
    expected = [r for r, root in zip(kept, roots, strict=True) if r[0] == root]
    kept = rows_of(step())
    assert Counter(kept) == Counter(expected)

    taken, _, _ = plain_mix(kept)
    expected = {r[0]: t for r, t in zip(kept, taken, strict=True) if t}
    mixed = step()
    assert mixed.columns == columns
    assert mixed.where("n_chars <> length(text)").count() == 0
    words, whole = Counter(), {r[0]: r[1] for r in kept}
    for doc_id, text, _ in (copies := rows_of(mixed)):
        words[doc_id] += size_of(text)
        assert whole[doc_id].startswith(text)
    assert words == expected

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc_id, text, _ in copies:
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        expected[doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids] += 1
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in step().collect())
    assert found == expected
    again = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in again) == found


def test_stages_take_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, Doc string"
    text = "some ordinary words of a text that goes on for a while and then ends without having said anything at all"
    rows = [(i, f"{text} {i} {i} {i} {i} {i}", "en", "a", 1, "x", "y") for i in range(20)]
    rows += [(None, None, None, None, None, None, None), (3, "", "en", None, 0, "x", "y"), (None, text, None, "a", 1, "x", "y"), rows[0], rows[0]]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == schema.replace(" string", "").replace(" long", "").split(", ")
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == bool(table)
