import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from paircraft.llm import langid, packing
from paircraft.llm.queries import ORACLE, QUERIES
from tests.llm import test_bpe_packing, test_jaccard_join, test_line_dedup, test_secrets

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names and set(QUERIES) <= names and set(ORACLE) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, "en", "s", 0), (10**9 + 1, "", None, None, 0), (10**9 + 2, "12 34", "en", "s", 5)],
                                docs.schema)
    docs.unionByName(odd).withColumn("doc", F.lit("extra")).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    model = langid.train(docs)
    got = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = got.collect()
        out = stage(spark, got, SF)
        if k < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / str(k)))
            out = spark.read.parquet(str(tmp_path / str(k)))
        after = out.collect()
        if k == 0:
            m = langid.Model(public_tokenizers.path(langid.VOCAB), *model)
            least = {r.lang_pred: r.least for r in langid.usual_fit(docs, model).collect()}
            keep = {r.doc_id for r, (lang, share, fit, n) in zip(before, m.predict([r.text for r in before]), strict=True)
                    if lang != "und" and share >= 0.5 and (n < langid.LETTERS_JUDGED or fit >= least[lang])}
            assert {r.doc_id for r in after} == keep and not keep & {10**9, 10**9 + 1, 10**9 + 2}
            assert len(keep) > 0.9 * len(before)
        elif k == 1:
            rows = {r.doc_id: r.text for r in after}
            import hashlib
            for d, _, _, sha in test_line_dedup.brute([(r.doc_id, r.text, r.source) for r in before]):
                assert hashlib.sha256(rows[d].encode()).hexdigest() == sha
        elif k == 2:
            keep = {d for d, _, c in test_jaccard_join.brute([(r.doc_id, r.text) for r in before]) if d == c}
            assert {r.doc_id for r in after} == keep and len(after) == len(keep)
        elif k == 3:
            spans = {x[0]: x[5] for x in test_secrets.brute([(r.doc_id, r.text, r.source, r.lang) for r in before])}
            texts = {r.doc_id: r.text for r in before}
            for r in after:
                want, at = "", 0
                for s in filter(None, spans[r.doc_id].split(",")):
                    b, e = map(int, s.split(":")[1:])
                    if b >= at:
                        want += texts[r.doc_id][at:b] + "[SECRET]"
                    at = max(at, e)
                assert r.text == want + texts[r.doc_id][at:]
        else:
            tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCAB))
            ids = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [2] for r in before}
            test_bpe_packing.check_pieces(after, ids, 4096)
        got = out


def test_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0 and "sequence_id" in docs.columns
