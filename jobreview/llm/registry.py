"""One query per operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F

from jobreview.llm import collocations, decontaminate, lexical, line_dedup, main_text, near_dups, topk, warc
from jobreview.llm.common import table
from jobreview.session import scratch_dir


def q_secrets(spark, sf_dir):
    from jobreview.llm.secret_scan import find_secrets, spans_text

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans_text(F.col("found")).alias("spans")
    )


def q_pieces(spark, sf_dir):
    """Pieces with merge-dropout (one candidate in ten is skipped), decoded and compared."""
    from jobreview.llm.sentencepieces import encode_table

    return encode_table(table(spark, sf_dir, "documents"))


def q_toxicity(spark, sf_dir):
    from jobreview.llm import toxicity as tox

    docs = table(spark, sf_dir, "documents")
    model = tox.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = tox.score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        tox.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= tox.THRESHOLD).cast("int").alias("predicted"),
    )


def q_decontaminate(spark, sf_dir):
    return decontaminate.mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def q_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def q_near_dups(spark, sf_dir):
    return near_dups.mark_near_duplicates(table(spark, sf_dir, "documents"), n_words=2)


def q_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def q_warc(spark, sf_dir):
    """Archives written to the shared folder, read back and assembled."""
    path = scratch_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_digests(warc.assemble(warc.landed_records(spark, path, payloads=False)))


def q_pii(spark, sf_dir):
    """Under the key of the session's setting ``jobreview.pii.key``; without one,
    a key of this run that nobody knows afterwards."""
    from jobreview.llm.pii import pseudonymise

    key = spark.conf.get("jobreview.pii.key", None) or secrets.token_hex(32)
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def q_repeats(spark, sf_dir):
    from jobreview.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def q_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return main_text.extract_main_text(pages, main_text.fit_labeller(pages), keep=["page_id", "url"])


def q_lexical(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def q_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op6_suffix_array_dedup": q_repeats,
    "op10_pii_pseudonyms": q_pii,
    "op4_warc": q_warc,
    "op1_kdtree_top_k": q_top_k,
    "op8_minhash_near_dedup": q_near_dups,
    "op5_line_dedup": q_line_dedup,
    "op3_decontaminate": q_decontaminate,
    "op7_toxicity": q_toxicity,
    "op2_sentencepiece": q_pieces,
    "op9_secret_scan": q_secrets,
    "op11_main_text": q_main_text,
    "op12_lexical_search": q_lexical,
    "op13_collocations": q_collocations,
}

SQL = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op8_minhash_near_dedup": near_dups.ORACLE,
    "op1_kdtree_top_k": topk.ORACLE,
    "op4_warc": warc.ORACLE,
    "op11_main_text": main_text.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_collocations": collocations.ORACLE,
}


def registry() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
