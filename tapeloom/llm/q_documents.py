"""The queries over documents, pages, vectors and conversations, each with the parameters of production."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.llm import centroids, chat_trees, filter_audit, mixing
from tapeloom.llm.base import table
from tapeloom.llm.catalog import query
from tapeloom.llm.fingerprints import fingerprint_edits
from tapeloom.llm.html_main import extract_pages
from tapeloom.llm.license_scan import license_scan
from tapeloom.llm.lm_score import cross_entropy_difference
from tapeloom.llm.ngram_join import near_duplicate_groups
from tapeloom.llm.packing import pack_documents
from tapeloom.llm.quality_model import score_quality
from tapeloom.llm.quality_rules import rule_verdicts
from tapeloom.llm.warc import archive_round_trip


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


@query("op3_lm_score")
def op3(spark, sf_dir):
    """The target are the documents that are labelled as good."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query("op4_poisson_mix", mixing.SQL_TWIN)
def op4(spark, sf_dir):
    copies = mixing.replicate(table(spark, sf_dir, "documents"))
    return copies.select("row.doc_id", "row.lang", "row.source", F.md5(F.coalesce("row.text", F.lit(""))).alias("text_md5"), "copy")


@query("op5_warc_round_trip")
def op5(spark, sf_dir):
    return archive_round_trip(table(spark, sf_dir, "pages"))


@query("op6_weighted_fingerprints")
def op6(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op7_main_text")
def op7(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op8_best_fit_packing")
def op8(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_quality_rules")
def op10(spark, sf_dir):
    return rule_verdicts(table(spark, sf_dir, "documents"))


@query("op11_centroid_clustering", centroids.SQL_TWIN)
def op11(spark, sf_dir):
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_chat_trees", chat_trees.SQL_TWIN)
def op12(spark, sf_dir):
    return chat_trees.conversation_digests(chat_trees.format_conversations(chat_trees.with_probe(table(spark, sf_dir, "conversations"))))


@query("op13_filter_audit", filter_audit.SQL_TWIN)
def op13(spark, sf_dir):
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
