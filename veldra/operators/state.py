"""Keyed state kept as tables: upserts, histories, deletions, forms and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.functions import text as T


def latest(df: DataFrame, key: str, value: str, at: Column) -> DataFrame:
    """The value put last under each key."""
    return df.groupBy(key).agg(F.max_by(value, at).alias(value))


def upsert_history(df: DataFrame, key: str, version: Column, at: Column) -> DataFrame:
    """``key, version, update_count, history``: the last version, how often it changed, and all versions in order."""
    entries = F.array_sort(F.collect_list(F.struct(at.alias("at"), version.alias("version"))))
    return df.groupBy(key).agg(F.max_by(version, at).alias("version"), (F.count("*") - 1).alias("update_count"), F.array_join(F.transform(entries, lambda e: e["version"]), ",").alias("history"))


def partial_update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a field that is null in ``new`` keeps its old value."""
    fields = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in fields))


def delete_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def fill_form(df: DataFrame, session: str, field: str, value: str, seq: Column) -> DataFrame:
    """The first value of each field that is no placeholder."""
    real = df.filter(F.col(value).isNotNull() & ~F.lower(T.strip(F.col(value))).isin(*T.PLACEHOLDERS))
    return real.groupBy(session, field).agg(F.min_by(value, seq).alias(value))


def merge_form(state: DataFrame, found: DataFrame, session: str, field: str, value: str) -> DataFrame:
    """Form values with those of ``found`` for fields that are still empty; placeholders fill nothing: ``session, field, value, filled`` (whether it is new)."""
    real = lambda c: c.isNotNull() & ~F.lower(T.strip(c)).isin(*T.PLACEHOLDERS)
    o, n = state.select(session, field, F.col(value).alias("__o")), found.select(session, field, F.col(value).alias("__n"))
    j = o.join(n, [session, field], "full_outer")
    fresh = ~F.coalesce(real(F.col("__o")), F.lit(False)) & F.coalesce(real(F.col("__n")), F.lit(False))
    return j.select(session, field, F.when(fresh, F.col("__n")).otherwise(F.coalesce("__o", F.lit(""))).alias(value), fresh.alias("filled"))


def form_progress(filled: DataFrame, fields: DataFrame, session: str, field: str) -> DataFrame:
    """``session, filled, missing, percent`` over all wanted fields.

    The wanted fields are one row, so each session is met by one list, not by every field.
    """
    wanted = fields.select(field).filter(F.col(field).isNotNull()).distinct().agg(F.array_sort(F.collect_list(field)).alias("__all"))
    own = filled.groupBy(session).agg(F.collect_set(field).alias("__own")).crossJoin(F.broadcast(wanted))  # one row
    missing = F.array_except("__all", "__own")
    n = F.size("__all") - F.size(missing)
    return own.select(session, n.cast("long").alias("filled"), F.array_join(missing, ",").alias("missing"), F.round(100 * n / F.size("__all"), 1).alias("percent"))


def turn_pairs(df: DataFrame, session: str, role: str, text: str, order: list[str]) -> DataFrame:
    """A question with the answer right after it, or with '' if none follows; answers alone are dropped."""
    w = Window.partitionBy(session).orderBy(*order)
    nxt = df.withColumn("__role", F.lead(role).over(w)).withColumn("__text", F.lead(text).over(w))
    return nxt.filter(F.col(role) == "user").withColumn("answer", F.when(F.col("__role") == "assistant", F.coalesce("__text", F.lit(""))).otherwise("")).drop("__role", "__text")


def last_n(df: DataFrame, by: str, order: list[str], n: int, oldest: bool = False) -> DataFrame:
    """The last (or the oldest) n rows of each group, numbered in ascending order in ``place``."""
    up = Window.partitionBy(by).orderBy(*order)
    pick = up if oldest else Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    kept = df.withColumn("__n", F.row_number().over(pick)).filter(F.col("__n") <= n).drop("__n")
    return kept.withColumn("place", F.row_number().over(up).cast("int"))


def cleared(df: DataFrame) -> DataFrame:
    """The table without a row, with its columns."""
    return df.filter(F.lit(False))


def put(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A table by key with rows put in: a new row takes the place of the old one of its key."""
    return state.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_document(chunks: DataFrame, new: DataFrame, metadata: DataFrame, source: str = "source_file", carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with those of the sources in ``new`` in the place of the old ones, and what is carried over from the metadata by source."""
    fresh = new
    if carry:
        m = metadata.select(source, *(F.col(c).alias(f"__{c}") for c in carry)).dropDuplicates([source])
        fresh = fresh.join(m, source, "left")
        for c in carry:
            fresh = fresh.withColumn(c, F.coalesce(c, f"__{c}") if c in new.columns else F.col(f"__{c}")).drop(f"__{c}")
    old = chunks.join(new.select(source).distinct(), source, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def edited(content: DataFrame, key: str = "source_file", text: str = "text") -> DataFrame:
    """An edited text as the one block of its document, in the form of parsed blocks."""
    return content.select(F.col(key).alias("doc_id"), F.lit(0).alias("block_index"), F.lit("text").alias("block_type"), F.col(text).alias("content"), F.lit(1).alias("page_no"), F.lit("1").alias("page_label"), F.lit("").alias("section"), F.lit(False).alias("is_table"))


def cascade(sessions: DataFrame, messages: DataFrame, gone: DataFrame, key: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without the sessions that go."""
    return delete_keys(sessions, gone, key), delete_keys(messages, gone, key)


def create_sessions(state: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions with those added whose key isn't there yet."""
    return state.unionByName(new.dropDuplicates([key]).join(state.select(key), key, "left_anti").select(*state.columns))


def rename(sessions: DataFrame, names: DataFrame, key: str = "session_id", title: str = "title") -> DataFrame:
    """Sessions with new titles where one is given."""
    n = names.groupBy(key).agg(F.max(title).alias("__t"))
    return sessions.join(n, key, "left").withColumn(title, F.coalesce("__t", title)).drop("__t").select(*sessions.columns)


def find_user(users: DataFrame, name: Column) -> DataFrame:
    """Users whose email or user name is the given one, without regard to case."""
    return users.filter((F.lower("email") == F.lower(name)) | (F.lower("username") == F.lower(name)))


def create_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """New users of whom neither email nor name is taken, the first of equal ones."""
    one = new.withColumn("__n", F.row_number().over(Window.partitionBy(F.lower("email")).orderBy("username"))).filter("__n = 1").drop("__n")
    one = one.withColumn("__n", F.row_number().over(Window.partitionBy(F.lower("username")).orderBy("email"))).filter("__n = 1").drop("__n")
    for c in ("email", "username"):
        one = one.join(users.select(F.lower(c).alias("__k")), F.lower(one[c]) == F.col("__k"), "left_anti")
    return one


def newest(df: DataFrame, at: str, tie: str) -> DataFrame:
    """Rows by time, the newest first; without a time last."""
    return df.orderBy(F.desc_nulls_last(at), tie)


def upload_times(files: DataFrame, registry: DataFrame, name: str = "file_name") -> DataFrame:
    """Files with the time of the registry, or else their own time of change."""
    r = registry.groupBy(name).agg(F.max("upload_time").alias("__t"))
    return files.join(r, name, "left").withColumn("uploaded", F.coalesce("__t", "modified")).drop("__t")


def sessions_of(sessions: DataFrame, user: str, owner: str = "user_id", at: str = "updated", tie: str = "session_id") -> DataFrame:
    """A user's sessions, the newest first; the default user sees all."""
    own = sessions if user == "default_user" else sessions.filter(F.col(owner) == user)
    return newest(own, at, tie)
