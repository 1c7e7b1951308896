"""The knowledge graph's state, derived from its ordered log of operations.

An operation has a sequence number; whatever the log says last about an id holds.
Everything here is a grouping or a join over the operations, so a state of any size
is rebuilt in parallel; only producing the operations is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.text import normalized
from recollect.operators.graph import ancestors, final_of, on_cycles
from recollect.operators.tables import kept, numbered

MAX_ATTEMPTS = 3


def last_write(df: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of each key's last row by ``order``, which should not tie."""
    latest = F.max_by(F.struct(*values), F.col(order)).alias("__v")
    return df.groupBy(*key).agg(latest, F.max(order).alias(order)).select(*key, "__v.*", order)


def current(observations: DataFrame) -> DataFrame:
    """Observations neither replaced nor forgotten."""
    return observations.where("replaced_by is null and forgotten is null")


def with_tombstones(observations: DataFrame, forgets: DataFrame) -> DataFrame:
    """``observations`` with forgotten, the first sequence number that forgot the id."""
    gone = forgets.groupBy("id").agg(F.min("seq").alias("forgotten"))
    return observations.drop("forgotten").join(gone, "id", "left")


def inherited(links: DataFrame, replacements: DataFrame) -> DataFrame:
    """(id, link) with the links of replaced ids passed on to what replaced them in the end.

    ``replacements`` has node and parent; ids keep their own links as well.
    """
    passed = links.join(final_of(replacements).withColumnRenamed("node", "id"), "id").select(F.col("final").alias("id"), "link")
    return links.select("id", "link").union(passed).distinct()


def merged_pages(links: DataFrame, edges: DataFrame, names: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (id, page), edges (node, parent) and names (page, name) after merges (node, parent).

    Links move and are deduplicated, children change parents, and the target gains the
    merged pages' names, their own ids too.
    """
    ends = final_of(merges).where("node != final").withColumnRenamed("node", "page")
    move = lambda df, c: df.join(ends.toDF(c, "__to"), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    moved = move(links, "page").distinct()
    own = ends.select(F.col("final").alias("page"), F.col("page").cast("string").alias("name"))
    named = move(names, "page").select("page", "name").union(own).distinct()
    parents = move(edges.join(ends.select(F.col("page").alias("node")), "node", "left_anti"), "parent").where("node != parent or parent is null")
    return moved, parents.select("node", "parent"), named


def creation_order(pages: DataFrame) -> DataFrame:
    """(page, parent, step) of new pages (page, parent): a page is made after its parent, steps from 0.

    Without a parent a page hangs below root. Parents that are not new exist already.
    Pages whose parents run in a circle are an error.
    """
    edges = kept(pages.select(F.col("page").alias("node"), F.coalesce("parent", F.lit("root")).alias("parent")))
    ring = on_cycles(edges).first()
    if ring is not None:
        raise ValueError(f"parents run in a circle at {ring['node']}")
    new = edges.select(F.col("node").alias("ancestor"))
    steps = ancestors(edges).join(new, "ancestor", "left_semi").groupBy("node").agg(F.max("depth").alias("step"))
    return edges.join(steps, "node").select(F.col("node").alias("page"), "parent", "step")


def reused_pages(pages: DataFrame, proposals: DataFrame) -> DataFrame:
    """``pages`` (page, line, parent, aliases, seq) with what ``proposals``, shaped alike, say of them.

    A proposal's line and parent replace the page's where they are given, its aliases
    are added; the sequence number moves on only if that changes anything.
    """
    told = proposals.select("page", *(F.col(c).alias(f"new_{c}") for c in ("line", "parent", "aliases", "seq")))
    line, parent = F.coalesce("new_line", "line"), F.coalesce("new_parent", "parent")
    aliases = F.array_union("aliases", F.coalesce("new_aliases", F.array().cast("array<string>")))
    same = line.eqNullSafe(F.col("line")) & parent.eqNullSafe(F.col("parent")) & (F.size(aliases) == F.size("aliases"))
    seq = F.when(~same, F.col("new_seq")).otherwise(F.col("seq"))
    return pages.join(told, "page", "left").select("page", line.alias("line"), parent.alias("parent"), aliases.alias("aliases"), seq.alias("seq"))


def patched(target: dict[str, Column], patch: dict[str, Column]) -> dict[str, Column]:
    """Fields of a target with those of a patch laid over; null leaves a field alone."""
    return {name: F.coalesce(patch[name], value) if name in patch else value for name, value in target.items()}


def stamp_conflict(target_seq: Column, stamp: Column) -> Column:
    """Whether the target changed after the writer last saw it."""
    return F.coalesce(target_seq > stamp, F.lit(False))


def focus_state(actions: DataFrame) -> DataFrame:
    """(folder, id) hidden now: the last action of each says hide."""
    return last_write(actions, ["folder", "id"], "seq", ["action"]).where("action = 'hide'").select("folder", "id")


def without_hidden(observations: DataFrame, links: DataFrame, hidden: DataFrame) -> DataFrame:
    """Observations that are not hidden themselves and lie on no hidden page."""
    by_page = links.join(hidden.select(F.col("id").alias("page")), "page", "left_semi").select("id")
    return observations.join(hidden.select("id").union(by_page).distinct(), "id", "left_anti")


def forgotten_views(views: DataFrame, forgets: DataFrame, parents: DataFrame) -> DataFrame:
    """``views`` without the forgotten ones and the views of all periods around them."""
    gone = ancestors(parents).join(forgets.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("ancestor").alias("id"))
    return views.join(gone.union(forgets.select("id")).distinct(), "id", "left_anti")


def entry_status(log: DataFrame, attempts: DataFrame) -> DataFrame:
    """(seq, status, attempts, error) of every log entry.

    ``attempts`` has seq, attempt, succeeded and message. One success is done; three
    failures leave the last message as error; anything less waits as failed, or queued
    where there was no attempt.
    """
    told = attempts.groupBy("seq").agg(F.bool_or("succeeded").alias("done"), F.count("*").alias("n"), F.max_by("message", "attempt").alias("message"))
    status = F.when(F.col("done"), "done").when(F.col("n").isNotNull(), "failed").otherwise("queued")
    error = F.when(~F.col("done") & (F.col("n") >= MAX_ATTEMPTS), F.col("message"))
    return log.select("seq").join(told, "seq", "left").select("seq", status.alias("status"), F.coalesce("n", F.lit(0)).alias("attempts"), error.alias("error"))


def eligible(log: DataFrame, state: DataFrame) -> DataFrame:
    """Entries that may be folded: without a state, or unfinished without an error."""
    known = state.select("seq", "status", "error")
    return log.join(known, "seq", "left").where("status is null or (status != 'done' and error is null)").select(*log.columns)


def retried(state: DataFrame, seq: int | None = None) -> DataFrame:
    """``state`` with the error of one entry, or of all, cleared and its attempts reset."""
    again = F.col("error").isNotNull() & (F.lit(True) if seq is None else F.col("seq") == seq)
    return state.withColumns({"attempts": F.when(again, 0).otherwise(F.col("attempts")), "error": F.when(again, None).otherwise(F.col("error"))})


def unresolved(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(seq, ref) of references to ids that do not exist."""
    return refs.join(known.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select("seq", "ref")


def overtaking(entries: DataFrame, refs: DataFrame, known: DataFrame) -> DataFrame:
    """``entries`` (seq, kind) with turn: structured entries whose references exist come first.

    Within both groups the log's order holds.
    """
    waiting = unresolved(refs, known).select("seq").distinct().withColumn("waits", F.lit(True))
    marked = entries.join(waiting, "seq", "left")
    ready = (F.col("kind") != "source") & F.col("waits").isNull()
    return marked.withColumn("phase", F.when(ready, 0).otherwise(1)).select(*entries.columns, "phase")


def dependency_order(entries: DataFrame, refs: DataFrame, makes: DataFrame, known: DataFrame) -> DataFrame:
    """``entries`` (seq, kind) with phase and turn, by which, and then by seq, they are folded; null while something they name is missing.

    Sources are folded in the log's order, the n-th opening phase n. Any other entry goes
    ahead of all that wait as soon as the ids it names (``refs``: seq, ref) are ``known``
    (id) or made (``makes``: seq, id) by what was folded before: in the phase in which the
    last of them comes to be, a turn after the entry that makes it. Each round places what
    the round before unblocked, so there are as many as the longest chain has entries.
    """
    named = kept(refs.select("seq", F.col("ref").alias("id")).distinct().join(known.select("id").distinct(), "id", "left_anti"))
    sources = numbered(entries.where("kind = 'source'").select("seq"), "phase", "seq").select("seq", F.col("phase").cast("long").alias("phase"), F.lit(0).alias("turn"))
    others = entries.where("kind != 'source'").select("seq")
    free = others.join(named.select("seq").distinct(), "seq", "left_anti").select("seq", F.lit(0).cast("long").alias("phase"), F.lit(1).alias("turn"))
    placed = kept(sources.union(free))
    waiting = named.join(others, "seq", "left_semi")
    while True:
        there = placed.join(makes.select("seq", "id"), "seq").groupBy("id").agg(F.min(F.struct("phase", "turn")).alias("at"))
        met = waiting.join(placed.select("seq"), "seq", "left_anti").join(there, "id", "left").groupBy("seq").agg(F.bool_and(F.col("at").isNotNull()).alias("whole"), F.max("at").alias("at"))
        new = kept(met.where("whole").select("seq", "at.phase", (F.col("at.turn") + 1).cast("int").alias("turn")))
        if new.isEmpty():
            return entries.join(placed, "seq", "left")
        placed = kept(placed.union(new))


def earlier_digests(entries: DataFrame) -> DataFrame:
    """(session, seq, n_earlier, earlier_md5) of ``entries`` (session, seq, digest).

    The hash is of the session's earlier digests in order, line feeds between them. Rows
    stream by session with one running hash, so a session may be of any length. A null
    digest is no digest; null sessions make one.
    """
    rows = entries.select("session", F.col("seq").cast("long").alias("seq"), F.col("digest").cast("string").alias("digest"))
    schema = T.StructType([rows.schema["session"], *(T.StructField(n, t) for n, t in (("seq", T.LongType()), ("n_earlier", T.LongType()), ("earlier_md5", T.StringType())))])
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(_running_digests, schema)


def _running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    session, n, running = object(), 0, hashlib.md5()
    for batch in batches:
        counts, hashes = [], []
        for own, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own != session:
                session, n, running = own, 0, hashlib.md5()
            counts.append(n)
            hashes.append(running.hexdigest())
            if digest is not None:
                running.update((b"\n" if n else b"") + digest.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hashes, pa.string())], names=["session", "seq", "n_earlier", "earlier_md5"])


def digest_context(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(session, seq, place, earlier): for entries of ``asked`` (session, seq) the digests before them, from 1."""
    before = asked.select("session", "seq").join(entries.select("session", F.col("seq").alias("at"), F.col("digest").alias("earlier")), "session").where("at < seq and earlier is not null")
    return before.withColumn("place", F.row_number().over(Window.partitionBy("session", "seq").orderBy("at"))).select("session", "seq", "place", "earlier")


def applied(changes: DataFrame) -> DataFrame:
    """``changes`` (id, seq, stamp) that take effect, in the log's order for each id.

    A change with a stamp is without effect if one that took effect came after the
    stamp; one without a stamp always takes effect. Rows stream by id.
    """
    rows = changes.select("id", F.col("seq").cast("long").alias("seq"), F.col("stamp").cast("long").alias("stamp"))
    return rows.repartition("id").sortWithinPartitions("id", "seq").mapInArrow(_applied, rows.schema)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, last = None, None
    for batch in batches:
        keep = []
        for id_, seq, stamp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if id_ != at:
                at, last = id_, None
            takes = stamp is None or last is None or last <= stamp
            keep.append(takes)
            if takes:
                last = seq
        yield batch.filter(pa.array(keep, pa.bool_()))


def page_violations(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(rule, item): what is wrong with proposed pages, given those that exist.

    ``pages`` has slug, action (reuse or create), parent, aliases and merge_from (arrays
    or null); ``known`` slug, parent and aliases. A name belongs to one page after the
    merges, whatever its case and punctuation, and parents may run in no circle then.
    """
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    merges = pages.select("slug", "action", F.explode(listed(F.col("merge_from"))).alias("gone"))
    exist = known.select("slug")
    made = pages.where("action = 'create'").select("slug")
    ends = merges.where("gone != slug").select(F.col("gone").alias("page"), F.col("slug").alias("to")).distinct()
    every = known.select("slug", "aliases").union(pages.select("slug", "aliases")).select(F.col("slug").alias("page"), F.explode(F.array_union(F.array("slug"), listed(F.col("aliases")))).alias("name"))
    owned = every.join(ends, "page", "left").select(F.coalesce("to", "page").alias("page"), normalized(F.col("name")).alias("name")).where("name != ''").distinct()
    told = pages.where("parent is not null").groupBy(F.col("slug").alias("node")).agg(F.min("parent").alias("new"))
    tree = known.select(F.col("slug").alias("node"), "parent").join(told, "node", "full").select("node", F.coalesce("new", "parent").alias("parent"))
    tree = tree.join(ends.toDF("node", "to"), "node", "left").where("to is null").drop("to").join(ends.toDF("parent", "to"), "parent", "left").select("node", F.coalesce("to", "parent").alias("parent"))
    parts = {
        "reused page does not exist": pages.where("action = 'reuse'").join(exist, "slug", "left_anti").select("slug"),
        "created page exists": made.join(exist, "slug", "left_semi"),
        "unknown parent": pages.select(F.col("parent").alias("slug")).where("slug is not null and slug != 'root'").join(exist.union(made), "slug", "left_anti"),
        "only reused pages merge others": merges.where("action != 'reuse'").select("slug"),
        "root is not merged": merges.where("gone = 'root'").select("slug"),
        "page merged into itself": merges.where("gone = slug").select("slug"),
        "page merged twice": merges.groupBy("gone").count().where("count > 1").select("gone"),
        "merged page does not exist": merges.select(F.col("gone").alias("slug")).where("slug != 'root'").join(exist, "slug", "left_anti"),
        "name belongs to two pages": owned.groupBy("name").agg(F.countDistinct("page").alias("n")).where("n > 1").select("name"),
        "parents run in a circle": on_cycles(tree.where("parent is null or parent != 'root'")),
    }
    found = None
    for rule, items in parts.items():
        rows = items.toDF("item").select(F.lit(rule).alias("rule"), "item")
        found = rows if found is None else found.union(rows)
    return found.distinct()


def proposal_violations(ops: DataFrame, pages: DataFrame, candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """(rule, item): what is wrong with a proposal; no rows if nothing is.

    ``ops`` has number, op, candidates, targets and page_keys (arrays) and line;
    ``pages`` key, slug, action, category, line and parent; ``candidates`` candidate and
    ``observations`` target, the ids that may be used. What needs the pages that exist
    is checked by ``page_violations``.
    """

    def found(rule: str, df: DataFrame, column: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("item"))

    used = ops.select("number", F.explode("candidates").alias("candidate"))
    targets = ops.select("number", F.explode("targets").alias("target"))
    keys = ops.select("number", F.explode("page_keys").alias("key"))
    n, m = F.size("targets"), F.size("candidates")
    fits = (
        F.when(F.col("op").isin("discard", "create"), n == 0)
        .when(F.col("op").isin("attach_source", "update"), n == 1)
        .when(F.col("op") == "merge", (n >= 1) & (n + m >= 2))
        .otherwise(n >= 1)
    )
    bare = F.col("op").isin("discard", "attach_source")
    name = F.regexp_replace(F.lower("slug"), "[^a-z0-9]+", " ")
    parts = [
        found("unknown op", ops.where(~F.col("op").isin(*OPS)), "op"),
        found("needs candidates", ops.where((m == 0) & (F.col("op") != "merge")), "number"),
        found("unknown candidate", used.join(candidates, "candidate", "left_anti"), "candidate"),
        found("candidate in two operations", used.groupBy("candidate").count().where("count > 1"), "candidate"),
        found("candidate not placed", candidates.join(used, "candidate", "left_anti"), "candidate"),
        found("unknown observation", targets.join(observations, "target", "left_anti"), "target"),
        found("observation in two operations", targets.groupBy("target").count().where("count > 1"), "target"),
        found("wrong number of observations", ops.where(~fits), "number"),
        found("payload must be empty", ops.where(bare & (F.col("line").isNotNull() | (F.size("page_keys") > 0))), "number"),
        found("needs a line", ops.where(~bare & (F.trim(F.coalesce("line", F.lit(""))) == "")), "number"),
        found("needs pages", ops.where(~bare & (F.size("page_keys") == 0)), "number"),
        found("unknown page key", keys.join(pages, "key", "left_anti"), "key"),
        found("page key twice", pages.groupBy("key").count().where("count > 1"), "key"),
        found("slug twice", pages.groupBy("slug").count().where("count > 1"), "slug"),
        found("unknown category", pages.where(~F.col("category").isin(*CATEGORIES)), "slug"),
        found("line repeats the name", pages.where(F.trim(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " ")) == F.trim(name)), "slug"),
        found("parents run in a circle", on_cycles(pages.select(F.col("slug").alias("node"), "parent")), "node"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result.distinct()


#: Fixed values of the data contract.
OPS = ("discard", "attach_source", "update", "create", "merge", "supersede")
CATEGORIES = ("actor", "artifact", "place", "event", "project", "topic")


def used_pages(pages: DataFrame, ops: DataFrame) -> DataFrame:
    """Proposed pages that an operation names or that are the parent of another proposed page."""
    named = ops.select(F.explode("pages").alias("page")).union(pages.where("parent is not null").select(F.col("parent").alias("page"))).distinct()
    return pages.join(named, "page", "left_semi")
