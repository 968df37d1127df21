"""Structural derivation: atoms, submission groups, turns and their context.

An *atom* is one message of a session in order. A *group* is what a user submits
before an assistant answers; a *turn* is a group with an authored message, and its
context is every atom from its first one to the next group's first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.user_text import split_user_text


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def actor_of(role: Column) -> Column:
    """Who speaks: the known roles as they are, tools' results as tool, all else as system."""
    role = F.lower(F.trim(role))
    return F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "model", "ai"), "assistant").when(role.isin("tool", "function"), "tool").otherwise("system")


def atomize(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """One atom per message: session, seq_no from 0, actor_kind, origin_kind, display_policy, text."""
    actor = actor_of(F.col(role))
    origin = F.when(actor == "user", "user_authored").when(actor == "assistant", "assistant_authored").otherwise("source_meta")
    out = messages.select(
        F.col(session).alias("session"),
        (F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1).alias("seq_no"),
        actor.alias("actor_kind"),
        origin.alias("origin_kind"),
        F.when(actor == "system", "hidden").otherwise("show").alias("display_policy"),
        F.col(text).alias("text"),
    )
    return out


def atomize_user_text(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """As ``atomize``, but a user's message gives one atom for each of its chunks; those that the user didn't write are injected or hidden."""
    actor = actor_of(F.col(role))
    plain = F.array(F.struct(F.when(actor == "assistant", "assistant_authored").otherwise("source_meta").alias("origin_kind"), F.col(text).alias("text"), F.when(actor == "system", "hidden").otherwise("show").alias("display_policy")))
    chunks = F.when(actor == "user", split_user_text(F.col(text))).otherwise(plain)
    cut = messages.select(F.col(session).alias("session"), F.col(order).alias("_o"), actor.alias("actor_kind"), F.posexplode(chunks).alias("_p", "_c"))
    number = F.row_number().over(Window.partitionBy("session").orderBy("_o", "_p")) - 1
    return cut.select("session", number.alias("seq_no"), "actor_kind", "_c.origin_kind", F.coalesce("_c.display_policy", F.lit("show")).alias("display_policy"), "_c.text")


def submission_groups(atoms: DataFrame) -> DataFrame:
    """The user atoms with their group_index.

    An authored atom opens a group if it is the first of the session, or if the
    assistant has spoken since the last authored atom (since the first user atom
    where none was authored). An injected atom opens one only as the first.
    """
    whole = Window.partitionBy("session").orderBy("seq_no")
    said = F.sum(F.when((F.col("actor_kind") == "assistant") & (F.col("display_policy") == "show"), 1).otherwise(0)).over(whole)
    users = atoms.withColumn("said", said).where("actor_kind = 'user'")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(F.when(F.col("origin_kind") == "user_authored", F.col("said")), ignorenulls=True).over(before), F.first("said").over(whole))
    first = F.row_number().over(whole) == 1
    opens = F.when(first, 1).when((F.col("origin_kind") == "user_authored") & (F.col("said") > last), 1).otherwise(0)
    return users.withColumn("opens", opens).withColumn("group_index", F.sum("opens").over(whole) - 1).drop("said", "opens")


def turns(atoms: DataFrame) -> DataFrame:
    """One row per group with an authored message: raw_text, its atoms' span and the start of the next group."""
    groups = submission_groups(atoms)
    each = groups.groupBy("session", "group_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_no", "text"))), lambda x: x["text"]), "\n\n").alias("raw_text"),
        F.min("seq_no").alias("first_seq"),
        F.count("*").alias("n_messages"),
        F.max((F.col("origin_kind") == "user_authored").cast("int")).alias("authored"),
    )
    nxt = F.lead("first_seq").over(Window.partitionBy("session").orderBy("group_index"))
    return each.withColumn("next_seq", nxt).where("authored = 1").drop("authored")


def context(atoms: DataFrame) -> DataFrame:
    """Per turn: how many assistant replies, system messages and tool atoms lie before the next group starts."""
    starts = submission_groups(atoms).groupBy("session", "group_index").agg(F.min("seq_no").alias("seq_no"), F.max((F.col("origin_kind") == "user_authored").cast("int")).alias("authored"))
    marked = atoms.join(starts, ["session", "seq_no"], "left")
    so_far = Window.partitionBy("session").orderBy("seq_no")
    marked = marked.withColumn("in_group", F.last("group_index", ignorenulls=True).over(so_far)).withColumn("of_turn", F.last("authored", ignorenulls=True).over(so_far))
    return (
        marked.where("in_group IS NOT NULL AND of_turn = 1")
        .groupBy("session", F.col("in_group").alias("group_index"))
        .agg(
            F.count(F.when(F.col("actor_kind") == "assistant", 1)).alias("assistant_replies"),
            F.count(F.when(F.col("actor_kind") == "system", 1)).alias("system_messages"),
            F.count(F.when(F.col("actor_kind") == "tool", 1)).alias("tool_atoms"),
            F.sum(F.when(F.col("actor_kind") == "assistant", F.length("text")).otherwise(0)).alias("reply_chars"),
        )
    )


def sessions(atoms: DataFrame) -> DataFrame:
    """Per session: its counts, its title (first authored text, squeezed, 72 characters) and its last actor."""
    squeezed = T.squeezed(F.regexp_replace("text", "<[^>]*>", " "))
    authored = F.when(F.col("origin_kind") == "user_authored", F.col("seq_no"))
    return atoms.groupBy("session").agg(
        F.count("*").alias("n_atoms"),
        F.count(authored).alias("n_authored"),
        F.left(F.min_by(squeezed, authored), F.lit(72)).alias("title"),
        F.max_by("actor_kind", "seq_no").alias("last_actor"),
    )


def spawned_from(rows: DataFrame, key: str, order: list[str], is_call: Column, is_text: Column, id_column: str) -> DataFrame:
    """(call id, id of the latest text before it) for each call that has one."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    source = F.last(F.when(is_text, F.col(id_column)), ignorenulls=True).over(before)
    return rows.withColumn("spawned_from", source).where(is_call & F.col("spawned_from").isNotNull()).select(F.col(id_column).alias("call_id"), "spawned_from")
