"""Queries of the text problems, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm import bpe, lookalike, neardup, oracles, packing, pii, topics
from wardloom.session import cut, drop
from wardloom.sources.tables import audit_events, spread, table


#: Subjects at most: each is a topic of the model.
MOST_SUBJECTS = 1_000


def prompts(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """event_id, input_prompt (not null) and ``more`` of audit_events, one row per event, spread out."""
    return audit_events(spark, folder, ["input_prompt", *more]).where("input_prompt is not null")


# ---- problem 3


def _names(spark: SparkSession, folder: str) -> pii.Names:
    return pii.names_of(spark, table(spark, folder, "name_lexicon"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value found in a prompt, once per event and kind."""
    found = pii.find_pii(prompts(spark, folder), "input_prompt", _names(spark, folder))
    rows = found.select("event_id", F.explode(F.array_distinct(F.transform("pii", lambda x: F.struct(x["pii_kind"].alias("pii_kind"), x["pii_text"].alias("pii_text"))))).alias("x"))
    return rows.select("event_id", "x.pii_kind", "x.pii_text").where(F.col("pii_kind").isin(*pii.KINDS))


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every prompt with typed placeholders in place of what was found."""
    return pii.redact_pii(prompts(spark, folder), "input_prompt", _names(spark, folder)).select("event_id", "redacted")


# ---- problem 4


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every prompt in its one form."""
    return lookalike.with_form(cut(prompts(spark, folder)), "input_prompt").select("event_id", "form")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of events whose prompts look the same but are not made of the same characters."""
    formed = lookalike.with_form(cut(prompts(spark, folder)), "input_prompt")
    return lookalike.same_look_pairs(formed, "event_id", "input_prompt", "form")


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of events whose prompts look the same, one row per event, with the number of events it is linked to."""
    formed = lookalike.with_form(cut(prompts(spark, folder)), "input_prompt")
    return lookalike.look_classes(formed, "event_id", "input_prompt", "form")


# ---- problem 6


def _edited(spark: SparkSession, folder: str, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = cut(prompts(spark, folder, *more))
    table = cut(neardup.word_table(events, "event_id", "input_prompt", list(more), 40))
    drop(events)
    return (table, *neardup.near_duplicates(table, "event_id", n_words=3, threshold=0.6))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of events with at least 40 words each that share 0.6 of their distinct three-word sequences."""
    _, members, links = _edited(spark, folder)
    return neardup.row_pairs(members, links, "event_id")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of each such event, with the user and the number of events it is linked to."""
    table, members, links = _edited(spark, folder, "user_id")
    found = neardup.groups(members, links, "event_id")
    return found.join(table.select("event_id", "user_id"), "event_id").select("event_id", F.col("group").alias("group_id"), "user_id", "copies", "links")


# ---- problems 7 and 8


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode_texts(spread(documents(spark, folder)), "doc_id", "text", "byte_bpe_50k")


def p7_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The number of tokens of every document, and whether its ids give the text back."""
    texts = spread(documents(spark, folder))
    ids = bpe.encode_texts(texts, "doc_id", "text")
    back = bpe.decode_ids(ids, "doc_id").withColumnRenamed("text", "again")
    same = F.coalesce("text", F.lit("")) == F.col("again")
    return texts.join(back, "doc_id").join(ids, "doc_id").select("doc_id", F.size("ids").alias("n_tokens"), same.alias("gives_back"))


def p8_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in windows of each capacity."""
    sizes = cut(bpe.count_tokens(spread(documents(spark, folder)), "doc_id", "text"))
    return packing.pack(sizes, table(spark, folder, "context_windows"), "doc_id")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Windows used and the share of their space that is used, by kind of window."""
    return packing.fill(p8_windows(spark, folder), table(spark, folder, "context_windows")).withColumn("filled", F.round("filled", 4))


# ---- problem 9


def _topic_model(spark: SparkSession, folder: str) -> tuple[DataFrame, topics.Model]:
    texts = spread(documents(spark, folder))
    words = topics.vocabulary(texts, "text")
    bags = cut(topics.word_ids(texts, "doc_id", "text", list(words)))
    rows = table(spark, folder, "subject_areas").select("subject").distinct().limit(MOST_SUBJECTS + 1).collect()
    if len(rows) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    subjects = sorted(r.subject for r in rows)
    return bags, topics.fit(bags, "doc_id", words, subjects)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects that about a fifth or more of a document's sentences are about."""
    bags, model = _topic_model(spark, folder)
    return topics.assign(bags, "doc_id", model).select("doc_id", "subject")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each subject in the corpus: documents that have it, and mean proportion among them."""
    bags, model = _topic_model(spark, folder)
    found = topics.assign(bags, "doc_id", model)
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.avg("proportion").alias("mean_proportion"))


QUERIES = {"p7_ids": p7_ids, "p7_lengths": p7_lengths, "p8_windows": p8_windows, "p8_fill": p8_fill, "p9_found": p9_found, "p9_shares": p9_shares, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_forms": p4_forms, "p4_classes": p4_classes, "p6_found": p6_found, "p6_groups": p6_groups}
SQL: dict[str, str] = {**oracles.SQL}
