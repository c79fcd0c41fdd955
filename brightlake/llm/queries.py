"""The registered queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightlake.llm import align, bpe, chat, decontaminate, html, language, lines, neardup, pii, repair, toxicity, whiten, winnow
from brightlake.llm.common import table
from brightlake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark, sf_dir):
    """Every document with the lines of recurring templates taken out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_recurring(docs)


@query
def op2_winnowing(spark, sf_dir):
    """Fingerprints of every text and of its edited text."""
    return winnow.compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark, sf_dir):
    """Words of every document inside a benchmark window."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_pii(spark, sf_dir):
    """Personal data in every document."""
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op5_html(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


@query
def op6_minhash(spark, sf_dir):
    """Near-duplicate class of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_bpe(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


@query
def op8_chat(spark, sf_dir):
    """Every maximal conversation, rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


ORACLES["op8_chat"] = chat.ORACLE.strip()


@query
def op9_toxicity(spark, sf_dir):
    """Score of every document, learned from the rows that are not held out."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_repair(spark, sf_dir):
    """Ids of every document as read back from the written shards."""
    path = scratch_path(spark, "token-shards")
    repair.write(table(spark, sf_dir, "documents"), vocabulary(), path)
    return repair.digests(spark, path)


@query
def op11_alignment(spark, sf_dir):
    """Groups and links between the tokens of two tokenizers, of every document."""
    return align.report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op12_language(spark, sf_dir):
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


@query
def op13_whitening(spark, sf_dir):
    """Every embedding on the leading components, whitened."""
    return whiten.whiten(table(spark, sf_dir, "embeddings"))
