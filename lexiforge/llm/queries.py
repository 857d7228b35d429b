"""Queries of this subpackage, one per operator, and their DuckDB SQL where it can say the
same. Each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read_docs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


from . import chain_dedup, ctph, embed_lsh, langid_gru, pack_bestfit, pareto_mix, periodic_runs  # noqa: E402
from . import simhash_trie, topk_nra, toxicity, url_templates, warc_revisit, whitening  # noqa: E402


@query("op1_url_templates", url_templates.oracle())
def op1_url_templates(spark, sf_dir):
    """A page's label is that of the document that it shows, which is the last number of its
    path: good if of quality and not toxic."""
    labels = read_docs(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(
        F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    pages = read_docs(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_templates.split_url(F.col("url"))[1], r"/(\d{1,18})(\.\w+)?/*$", 1)
    pages = pages.withColumn("shown", F.when(number != "", number.cast("long")))
    urls = pages.join(labels, pages.shown == labels.doc_id, "left").select("page_id", "url", "good")
    return url_templates.filter_urls(urls)


@query("op3_revisit_resolution", warc_revisit.oracle())
def op3_revisit_resolution(spark, sf_dir):
    out = warc_revisit.resolve(warc_revisit.records_of_pages(read_docs(spark, sf_dir, "pages")))
    h = F.col("headers")
    return out.withColumns({"etag": h["etag"], "last_modified": h["last-modified"], "content_type": h["content-type"],
                            "date": h["date"]}).drop("headers")


@query("op4_embedding_lsh", embed_lsh.oracle())
def op4_embedding_lsh(spark, sf_dir):
    return embed_lsh.near_duplicates(read_docs(spark, sf_dir, "embeddings"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs, labels = read_docs(spark, sf_dir), read_docs(spark, sf_dir, "labels")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = read_docs(spark, sf_dir)
    held = langid_gru.held_out(F.col("doc_id"))
    net = langid_gru.fit(docs.where(~held).select("text", "lang"))
    out = langid_gru.predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op8_ctph_fingerprint")
def op8_ctph_fingerprint(spark, sf_dir):
    return ctph.compare_successors(read_docs(spark, sf_dir))


@query("op5_pareto_mix", pareto_mix.oracle())
def op5_pareto_mix(spark, sf_dir):
    out = pareto_mix.mix(read_docs(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_bestfit_packing")
def op7_bestfit_packing(spark, sf_dir):
    return pack_bestfit.pack_documents(read_docs(spark, sf_dir), tokenizer_path())


@query("op9_simhash_trie")
def op9_simhash_trie(spark, sf_dir):
    out = simhash_trie.simhash_components(read_docs(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_chained_passages")
def op10_chained_passages(spark, sf_dir):
    out = chain_dedup.passages(read_docs(spark, sf_dir).select("doc_id", "text"))
    return out.drop("text_hash")


@query("op11_topk_nra", topk_nra.oracle())
def op11_topk_nra(spark, sf_dir):
    return topk_nra.top_k(read_docs(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whitening.by_component(whitening.whiten(read_docs(spark, sf_dir, "embeddings")))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    docs = read_docs(spark, sf_dir).select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.find_runs(docs, edit=periodic_runs.planted_tail))
