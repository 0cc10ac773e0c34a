"""Own columns of any name beside every operator that passes columns through."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import bitslice, decontaminate, filter_audit, hmm, lang_id, license_scan, media, merkle, mixing, near_dup, packing, sharding, url_filter
from skein.llm.names import numbered, with_results

NAMES = ["Score", "_own_score", "score_", "LANG_PRED", "language_share", "_row", "row_", "Hilbert", "shard", "own_shard", "media_parts", "Media_Type", "License_Matches", "_hit", "_kept", "v", "N", "salt", "_p0", "_tokens", "_k", "band", "own_0_", "_Found", "_lang"]
TEXTS = ["tako riko tako " * 5, "schein heit ung " * 5, "tako riko tako " * 5, None, "..."]


def rows(spark):
    """Documents with a column of every name, each with its own value in every row."""
    df = spark.createDataFrame([(i, t, "xx" if i % 2 else "yy", "s", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in NAMES])


def own_values(out, names):
    return all(r[names.index(n)] == f"{n}:{r[0]}" for r in out for n in NAMES if n in names)


STAGES = {
    "language": lambda spark, df: lang_id.keep_identified(df, 0.1),
    "near_dup": lambda spark, df: near_dup.drop_near_duplicates(df),
    "mixing": lambda spark, df: mixing.mixed(df, spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_return_the_columns_as_they_came(spark, monkeypatch, name):
    fast = lang_id.TrainingBounds(rows=50, spans=200, span=32, steps=20, batch=16)
    plain = lang_id.fit
    monkeypatch.setattr(lang_id, "fit", lambda docs: plain(docs, fast))
    df = rows(spark)
    out = STAGES[name](spark, df)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    assert got and set(got) <= {tuple(r) for r in df.collect()}
    assert STAGES[name](spark, df.filter("false")).count() == 0


RESULTS = {
    "identify": (lambda df: lang_id.identify(df, None), ["lang_pred", "score", "language_share"]),
    "hilbert": (lambda df: sharding.hilbert_shards(df, ["source", "doc_id"], ["doc_id"], 3), ["hilbert", "shard", "slot"]),
    "sniff": (lambda df: media.sniff(df.withColumn("Media_Parts", F.col("text").cast("binary")), "Media_Parts", "lang"), ["media_parts", "media_type", "media_corrected"]),
    "scan": (lambda df: license_scan.scan(df), ["license_matches"]),
}


@pytest.mark.parametrize("name", list(RESULTS))
def test_results_stand_beside_own_columns(spark, tmp_path, name):
    use, results = RESULTS[name]
    df = rows(spark)
    out = use(df)
    assert out.columns[-len(results) :] == results and len({c.lower() for c in out.columns}) == len(out.columns) == len(df.columns) + len(results)
    out.write.parquet(str(tmp_path / "out"))
    names = ["own_" + n if n.lower() in results and f"own_{n}" in out.columns else n for n in df.columns]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(TEXTS)
    for n in NAMES:
        kept = [c for c in out.columns if c.lower() in (n.lower(), "own_" + n.lower(), "own_own_" + n.lower()) and c not in results]
        assert kept, n
        if n != "media_parts":
            assert any({r[0] for r in back.select(c).collect()} == {f"{n}:{i}" for i in range(len(TEXTS))} for c in kept if c in names or c.startswith("own_")), n


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, B int, own_b int")
    plain, of = numbered(df)
    assert plain.columns == [of("a"), of("b"), of("OWN_B")] and plain.toDF(*df.columns).columns == df.columns
    with pytest.raises(ValueError):
        of("c")
    assert with_results(df.withColumn("x_", F.lit(1)), ["b"], ["x_"]).columns == ["a", "own_own_B", "own_b", "b"]


def test_stage_functions_say_what_they_do():
    assert all(stage.__doc__ and "empty" in stage.__doc__ for _, stage in corpus_pipeline.STAGES)


DOORS = {
    "hmm": lambda df, labels: hmm.score_documents(df),
    "bitslice": lambda df, labels: bitslice.top_rows(df.sparkSession.range(3).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"), F.lit("x").alias("EMBEDDING"), F.lit("y").alias("Vec_Id"))),
    "licenses": lambda df, labels: license_scan.licenses_of_documents(df),
    "mix": lambda df, labels: mixing.mix(df, labels),
    "pack": lambda df, labels: packing.digest(packing.pack(df, public_tokenizers.path("word_bpe_49k.json"))),
    "shards": lambda df, labels: sharding.document_shards(df),
    "urls": lambda df, labels: url_filter.judge(df.sparkSession.range(3).select(F.col("id").alias("page_id"), F.lit("http://a.com/en/1").alias("url"), F.lit("x").alias("URL"), F.lit("y").alias("Page_Id"))),
    "media": lambda df, labels: media.text_features(df),
    "near_dup": lambda df, labels: near_dup.near_duplicates(df),
    "merkle": lambda df, labels: merkle.proofs_of_documents(df),
    "audit": lambda df, labels: filter_audit.audit(df, labels),
    "decontaminate": lambda df, labels: decontaminate.contaminated_documents(df, labels.select(F.lit(1).alias("item_id"), F.lit("tako riko").alias("text"), F.lit("x").alias("Text")).toDF("item_id", "text", "Text")),
}


@pytest.mark.parametrize("name", list(DOORS))
def test_columns_that_bear_an_input_s_name(spark, name):
    """The column of the exact name is read, whatever other cases of it stand beside it."""
    plain = spark.createDataFrame([(i, t, "xx" if i % 2 else "yy", "s", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    odd = plain.select("*", *[F.lit("other").alias(k) for k in ("TEXT", "Doc_Id", "LANG", "Source", "N_CHARS", "row_id", "digest", "kept")])
    odd_labels = labels.select(F.lit(9).alias("Quality"), "*", F.lit(9).alias("TOXIC"), F.lit("z").alias("DOC_ID"))
    got, want = (sorted(map(tuple, DOORS[name](df, said).collect()), key=str) for df, said in ((odd, odd_labels), (plain, labels)))
    assert got and [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
