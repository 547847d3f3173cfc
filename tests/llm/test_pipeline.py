import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import ODD_TEXTS, docs_frame, labels_schema, with_clashes
from test_ngram_join import brute

import corpus_pipeline as P
from marginscope.llm import common, decontaminate, quality_crf, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_run_equals_the_stages_by_hand(spark):
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    rows = {r["doc_id"]: r for r in docs.collect()}
    ids = sorted(rows)
    q = quality_crf.fit_documents(docs, labels)
    ids = [i for i, s in zip(ids, q.score([rows[i]["text"] for i in ids])) if s >= 0.3]
    t = toxicity.fit_documents(docs.where(docs["doc_id"].isin(ids)), labels)
    score = t.score(t.matcher(), [rows[i]["text"] for i in ids])
    ids = [i for i, s in zip(ids, score) if s < 0.5]
    ids = sorted({c for _, c in brute([(i, rows[i]["text"]) for i in ids]).values()})
    finder = decontaminate.Finder([(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()])
    ids = [i for i in ids if not finder.matches(rows[i]["text"])]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queries.ranks(), special_tokens={})
    got = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    assert sorted(got) == ids and 300 < len(ids) < len(rows)
    for i in ids:
        raw = np.array(enc.encode_ordinary(rows[i]["text"] or ""), dtype="<u4").tobytes()
        assert bytes(got[i]["ids"]) == raw and got[i]["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((rows[i]["text"] or "").encode()).hexdigest()


def test_clean_documents_stay(spark):
    """Of the labelled good documents that aren't toxic, hardly any is rejected by the first two stages."""
    docs = common.table(spark, SF, "documents")
    kept = P.drop_toxic(spark, P.drop_low_quality(spark, docs, SF), SF).select("doc_id")
    good = common.table(spark, SF, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    assert good.join(kept, "doc_id").count() >= 0.98 * good.count()


@pytest.mark.parametrize("rows", [ODD_TEXTS, []])
def test_stages_take_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame([(5, 1, 0), (9, 0, 1)], labels_schema()).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = with_clashes(docs_frame(spark, rows), "score", "node", "component_id", "ids", "_text")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    # what each stage decides on these rows
    assert P.drop_contaminated(spark, docs, str(tmp_path)).count() == len(rows)
    unique = P.drop_near_duplicates(spark, docs, str(tmp_path))
    # of equal texts one stays, whatever their ids; texts without words are linked with nothing
    worded = {t for _, t in rows if t and t.strip()}
    assert sorted(str(r["text"]) for r in unique.collect()) == sorted([str(t) for _, t in rows if not (t and t.strip())] + list(worded))
    assert P.encode(spark, docs, str(tmp_path)).count() == len(rows)
