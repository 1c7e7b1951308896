"""The commands of a memory, over a log of entries in a folder.

A command that changes something appends its intent to the log; ``state`` derives
everything from the log by joins and groupings, so it can be thrown away and made anew
at any time. Commands append one entry, or one batch, at a time: there is one writer.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recollect.functions import scoring
from recollect.functions.calendar import LEVELS, parent_period
from recollect.functions.text import citations, observation_text
from recollect.operators import briefs, fold, reports, retrieval, timeline
from recollect.operators.budget import DIRECTORY_SHARE, NEXT_CAP, Brief, estimate
from recollect.operators.graph import affinity, descendants, folder_scores, predecessors
from recollect.operators.graph import cited as graph_cited
from recollect.operators.model import Model, Offline, with_text
from recollect.operators.postings import Postings
from recollect.operators.snapshots import MOST as SEGMENTS
from recollect.operators.snapshots import Snapshot, Snapshots
from recollect.operators.tables import kept
from recollect.operators.validation import SOURCE_KINDS, rated
from recollect.sources.log import ACTORS, ENTRY_KINDS, appended, dedup_key
from recollect.sources.registry import pending_order, sync_counts
from recollect.sources.routing import longest_prefix
from recollect.streaming import cursors

LOG = "seq long, kind string, actor string, created timestamp, payload string, hash string"
PAYLOAD = (
    "kind string, text string, label string, happened string, session string, line string, body string, authority string, "
    "confidence double, pages array<string>, target string, stamp long, patch map<string,string>, folder string, action string, "
    "page string, parent string, merge_into string, supersede boolean"
)
#: Digits of an observation's id: 64 bits, so that even billions of them hardly ever meet.
ID_DIGITS = 16
#: Fields that an edit may patch.
FIELDS = ("line", "body", "happened")
VIEW = "id string, kind string, scope string, seq long, text string, headline string, start date, input_ids array<string>, citations array<string>, version long"
#: Tables of the state.
RATINGS = ("reach", "surprise", "directive", "sensitivity")
ROW = (
    "id string, seq long, line string, body string, happened timestamp, entered timestamp, confidence double, source_prior double, sources long, pages array<string>, "
    "replaced_by string, durability double, forgotten long, reach double, surprise double, directive double, sensitivity double, at long"
)
CHUNK = "seq long, chunk int, start_line int, end_line int, context string, label string, text string"
EDIT = "seq long, id string, stamp long, supersede boolean, new_line string, new_body string, new_happened timestamp"
PAGE_EDIT = "seq long, page string, stamp long, line string, parent string, merge_into string"
#: How many times its budget a brief may take that a composition is to be made from.
COMPOSE_FACTOR = 4


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _reason(error: Exception) -> str:
    return next((x.strip() for x in str(error).splitlines() if x.strip()), type(error).__name__)[:200]


class Conflict(ValueError):
    """The log has the same key with another payload."""


@dataclass
class Synced:
    """Versions of units that a sync saw, sources that it appended, what it skipped, and the first of those rewritten or without a route."""

    units: int = 0
    submitted: int = 0
    skipped: int = 0
    rewritten: list[str] = field(default_factory=list)
    unrouted: list[str] = field(default_factory=list)


@dataclass
class State:
    """What a log amounts to."""

    observations: DataFrame
    links: DataFrame
    pages: DataFrame
    chunks: DataFrame
    hidden: DataFrame
    evidence: DataFrame
    names: DataFrame


class Memory:
    def __init__(self, spark: SparkSession, root: str, model: Model | None = None, now: str | None = None):
        self.root = root.rstrip("/")
        self.spark, self.path, self.model = spark, f"{self.root}/log", model or Offline()
        self.views_path = f"{self.root}/views"
        self.snapshots = Snapshots(spark, f"{self.root}/state")
        self._derived: tuple[int | None, State] | None = None
        self._searched: tuple[State, dict, dict | None] | None = None
        # The time is fixed once, so that all of a command's steps agree on it.
        self.now = F.lit(now or spark.sql("select current_timestamp()").first()[0]).cast("timestamp")

    def _table(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._table(self.path, LOG)

    def views(self, all_versions: bool = False) -> DataFrame:
        """Stored compositions and summaries of periods, of each the last one stored.

        A period that was forgotten since, or one inside it, is gone, and so is a folder's
        composition since something was hidden or shown there. ``all_versions`` are all
        that were ever stored.
        """
        told = self._table(self.views_path, VIEW).withColumn("version", F.coalesce("version", F.lit(0)))
        if all_versions:
            return told
        last = told.groupBy("id").agg(F.max_by(F.struct(*told.columns), F.struct("seq", "version")).alias("v")).select("v.*")
        forgets = self.entries().where("kind = 'forget' and p.target rlike '^(day|week|month|year):'").select(F.col("p.target").alias("id"), "seq")
        around = forgets
        for _ in LEVELS[1:]:
            forgets = forgets.select(parent_period(F.col("id")).alias("id"), "seq").where("id is not null")
            around = around.union(forgets)
        acts = self.entries().where("kind = 'focus'").select(F.concat(F.lit("composition:project:"), "p.folder").alias("id"), "seq")
        gone = around.union(acts).groupBy("id").agg(F.max("seq").alias("gone"))
        return last.join(gone, "id", "left").where("gone is null or seq >= gone").select(*(f.split()[0] for f in VIEW.split(", ")))

    def entries(self) -> DataFrame:
        """The log with its payloads' fields as p."""
        return self.log().withColumn("p", F.from_json("payload", PAYLOAD))

    def append(self, batch: DataFrame) -> DataFrame:
        """Appends rows (order, kind, actor, created, payload, hash); (order, seq, reused) of each.

        Raises Conflict, and appends nothing, if a row has another payload than the log.
        """
        batch = kept(batch)
        rows, outcome = appended(self.log(), batch)
        outcome = kept(outcome)
        if outcome.where("conflict").limit(1).count():
            raise Conflict("the log has this key with another payload, or the kind or actor is unknown")
        kept(rows).write.mode("append").parquet(self.path)
        return outcome.drop("conflict")

    def _one(self, kind: str, actor: str, payload: dict, text: str) -> int:
        """Appends one entry as ``append`` would a batch of one, reading no more of the log than keys and numbers."""
        if kind not in ENTRY_KINDS or actor not in ACTORS:
            raise Conflict("the kind or actor is unknown")
        told = json.dumps(payload, ensure_ascii=False, sort_keys=True)
        key = hashlib.sha256(f"{payload.get('kind') or kind}\x00{text}".encode()).hexdigest()
        last, known = self.log().agg(F.coalesce(F.max("seq"), F.lit(0)), F.min(F.when(F.col("hash") == key, F.col("seq")))).first()
        if known is not None:
            if self.log().where(F.col("seq") == known).first()["payload"] != told:
                raise Conflict("the log has this key with another payload")
            return known
        row = self.spark.createDataFrame([(last + 1, kind, actor, told, key)], "seq long, kind string, actor string, payload string, hash string")
        row.withColumn("created", self.now).select(*_names(LOG)).coalesce(1).write.mode("append").parquet(self.path)
        return last + 1

    def ingest(self, kind: str, text: str, label: str, happened: str | None = None, session: str | None = None) -> int:
        if kind not in SOURCE_KINDS or not text.strip() or not label.strip():
            raise ValueError("a source needs a known kind, a text and a label")
        return self._one("source", "user", {"kind": kind, "text": text, "label": label, "happened": happened, "session": session}, text)

    def ingest_dialogue(self, dialogue: str, label: str, happened: str | None = None, session: str | None = None) -> int:
        """A conversation from JSON: an array of messages (role, content), or an object with one as messages."""
        told = json.loads(dialogue)
        messages = told.get("messages") if isinstance(told, dict) else told
        if not isinstance(messages, list) or not all(isinstance(m, dict) and isinstance(m.get("role"), str) and isinstance(m.get("content"), str) for m in messages):
            raise ValueError("a dialogue is an array of messages with role and content")
        text = "\n\n".join(f"{m['role']}:\n{m['content']}" for m in messages)
        return self.ingest("conversation", text, label, happened, session)

    def sync(self, units: DataFrame, checkpoint: str, kind: str = "document", name: str = "files", routes: DataFrame | None = None, settle: float | None = None, cutoff: Column | None = None) -> Synced:
        """Imports what a stream of ``units`` (path, activity, content) has beyond the last run.

        What was taken of each unit is the state of the stream, in ``checkpoint``. Increments
        since ``cutoff`` whose path ``routes`` (root, home) lead somewhere, all of them
        where there are none, become sources in the order of their times; rewritten,
        unrouted and blank ones are skipped. An increment's key has the unit and its
        cursor, so one that is told again after a failure is reused.
        """
        out = Synced()

        def take(batch: DataFrame, _: int) -> None:
            told = kept(batch)
            due = told if cutoff is None else told.where(F.col("activity") >= cutoff)
            placed = due.withColumn("home", F.lit("")) if routes is None else longest_prefix(due, "path", routes)
            moved = F.col("status").isin("new", "appended") & (F.trim(F.coalesce("text", F.lit(""))) != "")
            placed = kept(placed.withColumn("messages", F.when(moved, 1).otherwise(0)).withColumn("happened", F.date_format("activity", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
            ready = pending_order(placed.where("messages > 0 and home is not null"), "path")
            cursor = F.concat(F.col("length").cast("string"), F.lit(":"), F.col("hash"))
            metadata = F.struct(F.struct("length", "hash").alias("cursor"), F.lit(name).alias("source_name"))
            payload = F.to_json(F.struct(F.lit(kind).alias("kind"), "text", F.col("path").alias("label"), "happened", F.col("path").alias("session"), F.when(F.col("home") != "", F.col("home")).alias("home"), metadata.alias("metadata")))
            key = dedup_key(F.lit(kind), F.col("text"), F.lit(name), F.col("path"), cursor)
            entries = kept(ready.select("order", F.lit("source").alias("kind"), F.lit("system").alias("actor"), F.col("activity").alias("created"), payload.alias("payload"), key.alias("hash"), "path"))
            outcome = self.append(entries.drop("path")).join(entries.select("order", "path"), "order")
            judged = placed.join(outcome.select("path", "reused", "seq"), "path", "left")
            counts = sync_counts(judged.select(F.col("path").alias("unit"), "home", "messages", "reused")).first()
            out.units, out.submitted, out.skipped = out.units + counts["units"], out.submitted + counts["submitted"], out.skipped + counts["skipped"]
            out.rewritten += [r["path"] for r in told.where("status = 'rewritten'").select("path").orderBy("path").limit(NEXT_CAP).collect()]
            out.unrouted += [r["path"] for r in placed.where("home is null and messages > 0").select("path").orderBy("path").limit(NEXT_CAP).collect()]

        with cursors.state_store(self.spark):
            query = cursors.increments(units, settle).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return out

    def note(self, line: str, pages: list[str], actor: str = "user", **fields) -> int:
        """An observation told directly; unless said otherwise a fact of confidence 1, its authority the actor."""
        if not line.strip() or not pages:
            raise ValueError("a note needs a line and pages")
        payload = {"kind": "fact", "confidence": 1.0, "authority": actor, "line": line, "pages": pages} | fields
        return self._one("note", actor, payload, json.dumps([line, pages]))

    def edit(self, target: str, stamp: int, supersede: bool = False, **patch: str) -> int:
        """Patches fields of an observation; without effect if it changed after ``stamp``.

        With ``supersede`` the patched observation is a new one that replaces the target.
        """
        if set(patch) - set(FIELDS):
            raise ValueError(f"unknown fields: {sorted(set(patch) - set(FIELDS))}")
        payload = {"target": target, "stamp": stamp, "patch": patch, "supersede": supersede}
        return self._one("edit", "user", payload, json.dumps(payload, sort_keys=True))

    def edit_page(self, page: str, stamp: int, line: str | None = None, parent: str | None = None, merge_into: str | None = None) -> int:
        """Gives a page a line or a parent, or merges it into another; without effect if it changed after ``stamp``.

        A page can't come below itself, nor be merged into itself.
        """
        s = self.state()
        known = {page, parent, merge_into} - {None, "root"}
        missing = known - {r["page"] for r in s.pages.where(F.col("page").isin(sorted(known))).select("page").collect()}
        if missing:
            raise ValueError(f"no pages {sorted(missing)}")
        asked = self.spark.createDataFrame([(page,)], "node string")
        below = descendants(s.pages.select(F.col("page").alias("node"), "parent"), asked)
        if merge_into == page or parent is not None and below.where(F.col("node") == parent).limit(1).count():
            raise ValueError(f"{page} would come below itself")
        payload = {"page": page, "stamp": stamp, "patch": {"line": line} if line is not None else {}, "parent": parent, "merge_into": merge_into}
        return self._one("edit", "user", payload, json.dumps(payload, sort_keys=True))

    def store_view(self, kind: str, scope: str, text: str, input_ids: list[str] | None = None, headline: str | None = None, start: str | None = None) -> None:
        """Keeps a composition (scope global or project:folder) or a period's summary, as of now."""
        last = self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        # A period is its own scope.
        name = scope if kind != "composition" and scope.startswith(f"{kind}:") else f"{kind}:{scope}"
        version = self.views(all_versions=True).where(F.col("id") == name).agg(F.coalesce(F.max("version") + 1, F.lit(0))).first()[0]
        row = [(name, kind, scope, last, text, headline, start, input_ids or [], version)]
        df = self.spark.createDataFrame(row, "id string, kind string, scope string, seq long, text string, headline string, start string, input_ids array<string>, version long")
        df.withColumn("start", F.col("start").cast("date")).withColumn("citations", citations(F.col("text"))).select(*(f.split()[0] for f in VIEW.split(", "))).write.mode("append").parquet(self.views_path)

    def forget(self, target: str) -> int:
        return self._one("forget", "user", {"target": target}, target)

    def focus(self, folder: str, target: str, action: str) -> int:
        if action not in ("hide", "show"):
            raise ValueError("hide or show")
        last = self.log().where("kind = 'focus'").count()
        return self._one("focus", "user", {"folder": folder, "target": target, "action": action}, json.dumps([folder, target, action, last]))

    def state(self) -> State:
        """Everything that the log amounts to, from the tables of the last step and the log's entries since."""
        last = self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        if self._derived is None or self._derived[0] != last:
            at = self.snapshots.newest()
            self._derived = last, self._loaded(at if at.seq == last else self._advanced(at, last))
        return self._derived[1]

    def rebuild(self) -> State:
        """Makes the state anew from the whole log, beside the present one, and then switches to it."""
        last = self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        self._derived = last, self._loaded(self._advanced(Snapshot(), last))
        return self._derived[1]

    def _rows(self, at: Snapshot) -> DataFrame:
        """The observations' last versions."""
        told = self.snapshots.read(at, "rows", ROW)
        if len(at.tables.get("rows", [])) < 2:
            return told
        return told.groupBy("id").agg(F.max_by(F.struct(*told.columns), "at").alias("r")).select("r.*")

    def _loaded(self, at: Snapshot) -> State:
        full = kept(self._rows(at).drop("at"))
        links, pages, names = self._pages(full, self.snapshots.read(at, "page_edits", PAGE_EDIT) if at.tables.get("page_edits") else None)
        acts = self.snapshots.read(at, "acts", "folder string, id string, seq long, action string")
        evidence = self.snapshots.read(at, "evidence", "chunk string, observation string")
        replaced = full.where("replaced_by is not null").select(F.col("id").alias("node"), F.col("replaced_by").alias("parent"))
        if not replaced.isEmpty():
            # What an observation rests on is passed on to what replaced it.
            passed = fold.inherited(evidence.select(F.col("observation").alias("id"), F.col("chunk").alias("link")), replaced)
            evidence = kept(passed.select(F.col("link").alias("chunk"), F.col("id").alias("observation")))
        return State(full.drop("pages"), links, pages, self.snapshots.read(at, "chunks", CHUNK), fold.focus_state(acts), evidence, names)

    def _advanced(self, at: Snapshot, last: int) -> Snapshot:
        """The state after the entries behind ``at``; of the tables before, only rows that those name are read by id.

        Edits of ids that do not exist yet wait for them.
        """
        entries = kept(self.entries().where((F.col("seq") > at.seq) & (F.col("seq") <= last)))
        target = F.col("p.target").alias("id")
        of = {
            "source": F.col("kind") == "source", "note": F.col("kind") == "note", "edits": (F.col("kind") == "edit") & F.col("p.target").isNotNull(),
            "page_edits": (F.col("kind") == "edit") & F.col("p.page").isNotNull(), "forgets": F.col("kind") == "forget", "acts": F.col("kind") == "focus",
        }
        # What no entry tells of is not touched.
        told = entries.agg(*(F.count_if(x).alias(name) for name, x in of.items())).first()
        added = {}
        if told["page_edits"]:
            added["page_edits"] = entries.where(of["page_edits"]).select("seq", F.col("p.page").alias("page"), "p.stamp", F.try_element_at("p.patch", F.lit("line")).alias("line"), "p.parent", "p.merge_into")
        if told["forgets"]:
            added["forgets"] = entries.where(of["forgets"]).select(target, "seq")
        if told["acts"]:
            added["acts"] = entries.where(of["acts"]).select("p.folder", target, "seq", "p.action")
        if told["source"] or told["note"] or told["edits"] or told["forgets"]:
            added |= self._moved(at, last, entries, of, told)
        now = self.snapshots.advance(at, last, added)
        crowded = {name for name, own in now.tables.items() if len(own) > SEGMENTS}
        if not crowded:
            return now
        schemas = {"chunks": CHUNK, "evidence": "chunk string, observation string", "page_edits": PAGE_EDIT, "forgets": "id string, seq long", "waiting": EDIT, "acts": "folder string, id string, seq long, action string"}
        return self.snapshots.advance(now, last, {}, {name: self._rows(now) if name == "rows" else self.snapshots.read(now, name, schemas[name]) for name in crowded})

    def _moved(self, at: Snapshot, last: int, entries: DataFrame, of: dict[str, Column], told: Row) -> dict[str, DataFrame]:
        """The rows that new entries make or change, with chunks, evidence and edits that wait."""
        before, added, made = self._rows(at), {}, None
        fields = ["id", "seq", "line", "body", "happened", "entered", "confidence", "source_prior", "sources", "pages"]
        if told["source"]:
            sources = entries.where(of["source"]).select("seq", "created", "p.text", "p.label", "p.happened", F.col("p.kind").alias("source_kind"))
            chunks = kept(with_text(self.model.chunks(sources), sources))
            added["chunks"] = chunks.select(*_names(CHUNK))
            made = self.model.observations(chunks).select("seq", F.col("chunk").alias("n"), "line", F.array("page").alias("pages"))
        if told["note"]:
            notes = entries.where(of["note"]).select("seq", F.lit(0).alias("n"), "p.line", "p.pages")
            made = notes if made is None else made.unionByName(notes)
        base = before.where("false").select(*fields)
        if made is not None:
            made = made.join(entries.select("seq", "created", "actor", "kind", "p.body", "p.happened", "p.confidence", F.col("p.kind").alias("payload_kind")), "seq")
            made = made.withColumn("id", F.left(F.sha2(F.concat_ws("/", F.col("seq").cast("string"), F.col("n").cast("string")), 256), F.lit(ID_DIGITS)))
            made = kept(made) if told["source"] else made
            prior = scoring.source_prior(scoring.source_kind(F.col("kind"), F.col("actor"), F.col("payload_kind")))
            happened = F.col("happened").try_cast("timestamp").alias("happened")
            base = made.select("id", "seq", "line", "body", happened, F.col("created").alias("entered"), F.coalesce("confidence", F.lit(0.9)).alias("confidence"), prior.alias("source_prior"), F.lit(1).cast("long").alias("sources"), "pages")
            if told["source"]:
                chunk = F.concat(F.lit("src:"), F.col("seq").cast("string"), F.lit("/"), F.col("n").cast("string"))
                added["evidence"] = made.where("kind = 'source'").select(chunk.alias("chunk"), F.col("id").alias("observation"))

        target = F.col("p.target").alias("id")
        patches = (F.try_element_at("p.patch", F.lit(f)).alias(f"new_{f}") for f in FIELDS)
        fresh = entries.where(of["edits"]).select("seq", target, "p.stamp", F.coalesce("p.supersede", F.lit(False)).alias("supersede"), *patches).withColumn("new_happened", F.col("new_happened").try_cast("timestamp"))
        waited = self.snapshots.read(at, "waiting", EDIT)
        edits = kept(fresh.select(*_names(EDIT)).union(waited.join(before.select("id"), "id", "left_anti").select(*_names(EDIT)))) if told["edits"] or at.tables.get("waiting") else waited
        forgets = entries.where(of["forgets"]).select(target, "seq")
        # Rows of before that an edit or a forget names.
        named = before.where("false")
        if told["edits"] or told["forgets"]:
            named = kept(before.join(fresh.select("id").union(forgets.select("id")).distinct(), "id", "left_semi"))
        patched = self._patched(base.unionByName(named.where("replaced_by is null").select(*fields)), edits)
        whole = patched.select(*fields, "replaced_by").unionByName(named.where("replaced_by is not null").select(*fields, "replaced_by"))
        whole = kept(whole.withColumn("durability", F.lit(30.0)))
        known = named.select("id", "line", *RATINGS)
        asked = whole.select("id", "line").join(known, ["id", "line"], "left_anti")
        ratings = known.unionByName(self.model.ratings(asked).select("id", "line", *RATINGS))
        gone = self.snapshots.read(at, "forgets", "id string, seq long").union(forgets)
        added["rows"] = rated(fold.with_tombstones(whole, gone), ratings).withColumn("at", F.lit(last)).select(*_names(ROW))
        if told["edits"]:
            late = fresh.select(*_names(EDIT)).join(before.select("id").union(whole.select("id")), "id", "left_anti")
            if not late.isEmpty():
                added["waiting"] = late.select(*_names(EDIT))
        return added

    @staticmethod
    def _patched(base: DataFrame, edits: DataFrame) -> DataFrame:
        """Observations after their edits; each round follows what superseding edits made in the round before."""
        level, out = base, None
        if edits.isEmpty():
            return level.withColumn("replaced_by", F.lit(None).cast("string"))
        while True:
            own = edits.join(level.select("id"), "id", "left_semi")
            changes = level.select("id", "seq", F.lit(None).cast("long").alias("stamp")).union(own.select("id", "seq", "stamp"))
            taken = own.join(fold.applied(changes).select("id", "seq"), ["id", "seq"], "left_semi")
            end = taken.where("supersede").groupBy("id").agg(F.min("seq").alias("end"))
            taken = kept(taken.join(end, "id", "left").where("end is null or seq <= end"))
            last = taken.where("not supersede").groupBy("id").agg(F.max("seq").alias("edited"), F.count("*").alias("edits"), *(F.max_by(f"new_{f}", F.when(F.col(f"new_{f}").isNotNull(), F.col("seq"))).alias(f"new_{f}") for f in FIELDS))
            now = level.join(last, "id", "left").withColumns({f: F.coalesce(f"new_{f}", f) for f in FIELDS})
            now = now.withColumns({"source_prior": F.when(F.col("edits") > 0, 1.0).otherwise(F.col("source_prior")), "sources": F.col("sources") + F.coalesce("edits", F.lit(0)), "seq": F.greatest("seq", "edited")})
            id_ = F.left(F.sha2(F.concat_ws("/", F.col("end").cast("string"), F.lit("0")), 256), F.lit(ID_DIGITS))
            heirs = taken.where("supersede and seq = end").select("id", "end", id_.alias("heir"), *(F.col(f"new_{f}").alias(f"heir_{f}") for f in FIELDS))
            now = kept(now.select(*level.columns).join(heirs, "id", "left"))
            old = now.withColumn("seq", F.greatest("seq", "end")).select(*level.columns, F.col("heir").alias("replaced_by"))
            out = old if out is None else out.unionByName(old)
            made = now.where("heir is not null").withColumns({f: F.coalesce(f"heir_{f}", f) for f in FIELDS})
            if made.isEmpty():
                return out
            level = made.withColumns({"id": F.col("heir"), "seq": F.col("end"), "source_prior": F.lit(1.0), "sources": F.col("sources") + 1}).select(*level.columns)

    def _pages(self, full: DataFrame, page_edits: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Links (id, page), pages (page, category, line, parent, seq) and their names (page, name)."""
        links = full.select("id", "seq", F.explode("pages").alias("page"))
        born = links.groupBy("page").agg(F.min("seq").alias("seq"))
        if page_edits is None:
            none = F.lit(None).cast("string")
            pages = kept(links.groupBy("page").agg(F.max("seq").alias("seq")).select("page", F.lit("topic").alias("category"), none.alias("line"), none.alias("parent"), "seq"))
            return kept(links.select("id", "page").distinct()), pages, pages.select("page", F.col("page").alias("name"))
        told = kept(page_edits)
        changes = born.select(F.col("page").alias("id"), "seq", F.lit(None).cast("long").alias("stamp")).union(told.select(F.col("page").alias("id"), "seq", "stamp"))
        taken = kept(told.join(fold.applied(changes).select(F.col("id").alias("page"), "seq"), ["page", "seq"], "left_semi"))
        latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        last = taken.groupBy("page").agg(latest("line"), latest("parent"), F.max("seq").alias("edited"))
        edges = born.join(last, "page", "left").select(F.col("page").alias("node"), F.when(F.col("parent") != "root", F.col("parent")).alias("parent"))
        merges = taken.where("merge_into is not null").groupBy(F.col("page").alias("node")).agg(F.max_by("merge_into", "seq").alias("parent"))
        names = born.select("page", F.col("page").alias("name"))
        moved, parents, named = links.select("id", "page").distinct(), edges, names
        if not merges.isEmpty():
            moved, parents, named = fold.merged_pages(moved, edges, names, merges)
        moved, parents = kept(moved.select("id", "page")), kept(parents)
        changed = moved.join(full.select("id", "seq"), "id").groupBy("page").agg(F.max("seq").alias("seq"))
        pages = changed.join(last.select("page", "line", "edited"), "page", "left").join(parents.withColumnRenamed("node", "page"), "page", "left")
        pages = kept(pages.select("page", F.lit("topic").alias("category"), "line", "parent", F.greatest("seq", "edited").alias("seq")))
        return moved, pages, kept(named.select("page", "name"))

    def brief(self, budget: int = briefs.GLOBAL, folder: str | None = None, state: State | None = None, page: str | None = None, with_global: bool = True) -> Brief:
        """The standing brief, that of a folder, after the standing one unless told otherwise, or that of a page and all below it.

        A stored composition that is still valid stands in place of a choice of lines.
        """
        s = state or self.state()
        rows = briefs.ranked(fold.current(s.observations), self.now)
        edges = s.pages.select(F.col("page").alias("node"), "parent")
        if page is not None:
            below = kept(descendants(edges, self.spark.createDataFrame([(page,)], "node string")).select(F.col("node").alias("page")))
            links = s.links.join(below, "page", "left_semi")
            return briefs.brief(rows.join(links.select("id").distinct(), "id", "left_semi"), links, s.pages, f"# {page}\n", budget)
        if folder is None:
            return self._standing(s, rows, edges, budget)
        hidden = kept(s.hidden.where(F.col("folder") == folder).select("id"))
        below = descendants(edges, hidden.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
        own = fold.without_hidden(rows, s.links, hidden.union(below).distinct())
        if not with_global:
            return self._project(s, own, edges, folder, budget, set(), hidden)
        share = budget * briefs.GLOBAL // (briefs.GLOBAL + briefs.PROJECT)
        out = self._standing(s, own, edges, share)
        more = self._project(s, own, edges, folder, budget - share, set(out.shown), hidden)
        out.text, out.shown = f"{out.text}\n\n{more.text}", out.shown + more.shown
        out.tokens, out.truncated, out.next = estimate(out.text), out.truncated or more.truncated, (out.next + more.next)[:NEXT_CAP]
        return out

    def _stored(self, s: State, scope: str) -> Brief | None:
        since_gone = s.observations.withColumn("seq", F.greatest("seq", "forgotten"))
        found = timeline.stored_composition(self.views(), since_gone, scope).select("text", "citations").first()
        return None if found is None else Brief(found["text"], estimate(found["text"]), list(found["citations"]))

    def _project(self, s: State, rows: DataFrame, edges: DataFrame, folder: str, budget: int, shown: set[str], hidden: DataFrame) -> Brief:
        """What lies on pages that the folder's path names, or below those, the closer the higher.

        Pages share the budget by their affinity; lines on none of them are not told.
        """
        title = f"# Project: {folder.rstrip('/').rsplit('/', 1)[-1]}\n"
        stored = self._stored(s, f"project:{folder}")
        if stored is not None:
            stored.text = f"{title}\n{stored.text}"
            return stored
        scores = folder_scores(F.lit(folder), s.names)
        near = kept(affinity(scores, edges, hidden.select(F.col("id").alias("page"))))
        links = kept(s.links.join(near.select("page"), "page", "left_semi").select("id", "page"))
        best = links.join(near, "page").groupBy("id").agg(F.max("affinity").alias("affinity"))
        closer = rows.join(best, "id").withColumn("rank", F.col("rank") * (1 + F.col("affinity"))).drop("affinity")
        return briefs.brief(closer, links, s.pages, title, budget, near, hidden=shown)

    def _standing(self, s: State, rows: DataFrame, edges: DataFrame, budget: int) -> Brief:
        """History, the standing part and recent days, under the day it tells of."""
        stored = self._stored(s, "global")
        cited = set(stored.shown) if stored is not None else set()
        periods = kept(self._covering())
        history, recent, open_ids, cut = "", "", [], False
        if not periods.isEmpty():
            latest = self.views().where("kind = 'day'").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            live = fold.current(s.observations).select("id", "line", "seq", F.to_date("happened").alias("day"))
            history, recent, open_ids, cut = briefs.timeline(periods, live, latest, cited)
        shown = cited | set(open_ids)
        if stored is not None:
            out = stored
            out.text += briefs.directory(rows, s.links, edges, sorted(shown), int(budget * DIRECTORY_SHARE))
        else:
            out = briefs.brief(rows, s.links, s.pages, "", budget, edges=edges, hidden=shown)
        day = rows.select(F.date_format(self.now, "yyyy-MM-dd")).first()
        head = f"# Memory (as of {day[0]})" if day else "# Memory"
        out.text = "\n\n".join([head, *(x.strip() for x in (history, out.text, recent) if x.strip())])
        out.tokens, out.truncated, out.shown = estimate(out.text), out.truncated or cut, [*out.shown, *open_ids]
        return out

    def _covering(self) -> DataFrame:
        """The coarsest stored periods that tell of the days before today."""
        periods = self.views().where("kind != 'composition'")
        days = periods.where("kind = 'day'").select(F.substring("id", 5, 10).try_cast("date").alias("day")).where("day is not null").distinct()
        cover = timeline.cover(days, periods.select(F.col("id").alias("period")), self.now.cast("date"))
        return periods.join(cover.withColumnRenamed("period", "id"), "id", "left_semi")

    def compose_input(self, budget: int = briefs.GLOBAL) -> Brief:
        """The wider choice of lines that a composition is to be made from."""
        s = self.state()
        return briefs.brief(briefs.ranked(fold.current(s.observations), self.now), s.links, s.pages, "", COMPOSE_FACTOR * budget)

    def since(self, seq: int, budget: int = briefs.RECALL) -> tuple[list[str], int]:
        """Lines that tell what was said or edited after ``seq``, and where to go on from."""
        s = self.state()
        return briefs.since(s.observations, s.pages.withColumn("line", F.coalesce("line", "page")), seq, budget)

    def changes(self, seq: int, budget: int = briefs.RECALL) -> briefs.Changes:
        """What changed after ``seq``, forgetting too: what an observation was replaced by, what was forgotten, and what did not fit."""
        if seq < 0:
            raise ValueError("seq must not be negative")
        s = self.state()
        gone = s.observations.withColumn("seq", F.greatest("seq", "forgotten"))
        pages = s.pages.withColumn("line", F.concat(F.lit("— "), F.col("line")))
        return briefs.changes(gone, pages, seq, budget)

    def _indexed(self, layer: str, rows: DataFrame) -> tuple[Postings, DataFrame, str]:
        """The layer's stored postings and vectors, brought up to ``rows`` (key, text), and why vectors are missing, if so.

        Only texts that the index does not have are cut and embedded; a changed text is a
        new key, and keys that are no longer there are taken out.
        """
        home = f"{self.root}/index/{self._index_name()}/{layer}"
        postings = Postings(self.spark, home)
        known = postings.documents().select("id")
        fresh = kept(rows.join(known.withColumnRenamed("id", "key"), "key", "left_anti"))
        gone = known.join(rows.select(F.col("key").alias("id")), "id", "left_anti")
        if not (fresh.isEmpty() and gone.isEmpty()):
            postings.extend(fresh.select(F.col("key").alias("id"), "text"), gone)
        vectors = self._table(f"{home}/vectors", "id long, vector array<float>")
        try:
            missing = rows.join(vectors.select(F.col("id").alias("key")), "key", "left_anti")
            if not missing.isEmpty():
                missing.select(F.col("key").alias("id"), self.model.embedded(F.col("text")).cast("array<float>").alias("vector")).write.mode("append").parquet(f"{home}/vectors")
        except Exception as error:  # whatever a model's call raises
            return postings, vectors, _reason(error)
        live = self._table(f"{home}/vectors", "id long, vector array<float>").dropDuplicates(["id"])
        return postings, live.join(rows.select(F.col("key").alias("id")), "id", "left_semi"), ""

    def _index_name(self) -> str:
        told = self._table(f"{self.root}/index/names", "n long, name string").orderBy(F.desc("n")).first()
        return told["name"] if told else "first"

    def reindex(self) -> None:
        """Makes postings and vectors of both layers anew, beside those in use, and then switches to them."""
        before = self._index_name()
        name, n = f"made-{uuid.uuid4().hex}", self._table(f"{self.root}/index/names", "n long, name string").count() + 1
        self._index_name = lambda: name
        try:
            for layer, rows in self._layers(self.state()).items():
                reason = self._indexed(layer, rows.select("key", "text"))[2]
                if reason:
                    raise RuntimeError(f"{before} stays in use: {reason}")
        finally:
            del self._index_name
        self.spark.createDataFrame([(n, name)], "n long, name string").write.mode("append").parquet(f"{self.root}/index/names")
        self._searched = None

    def _layers(self, s: State) -> dict[str, DataFrame]:
        """What a search reads: current observations and chunks, with text and key."""
        chunks = s.chunks.withColumn("id", F.concat(F.lit("src:"), F.col("seq").cast("string"), F.lit("/"), F.col("chunk").cast("string")))
        texts = {"observation": (fold.current(s.observations), observation_text(F.col("line"), F.col("body"))), "chunk": (chunks.withColumnRenamed("text", "passage"), F.concat_ws("\n", "context", "passage"))}
        return {layer: df.withColumn("text", text).withColumn("key", F.xxhash64("id", "text")) for layer, (df, text) in texts.items()}

    def _kept_layers(self, s: State) -> dict[str, DataFrame]:
        if self._searched is None or self._searched[0] is not s:
            self._searched = s, {name: kept(df) for name, df in self._layers(s).items()}, None
        return self._searched[1]

    def _indexes(self, s: State, layers: dict[str, DataFrame]) -> dict[str, tuple[Postings, DataFrame, str]]:
        """The layers' indexes; one state is compared with them once, and again while vectors are missing."""
        if self._searched[2] is None or any(x[2] for x in self._searched[2].values()):
            self._searched = s, layers, {name: self._indexed(name, df.select("key", "text")) for name, df in layers.items()}
        return self._searched[2]

    def search(self, query: str | list[str], state: State | None = None, pages: list[str] | None = None) -> DataFrame:
        """(id, layer, line, score) of current observations and of chunks, at most ``MAX_HITS``.

        Both retrievers over both layers are fused over all queries; observations on pages
        that a query names count more. ``pages`` limits both layers to what lies on them.
        """
        return self._search(query, state, pages)[0]

    def _search(self, query: str | list[str], state: State | None, pages: list[str] | None) -> tuple[DataFrame, str]:
        """The hits, and why they are lexical only, if so."""
        s = state or self.state()
        queries = [query] if isinstance(query, str) else query
        if not queries or not all(q.strip() for q in queries):
            raise ValueError("queries must not be empty")
        asked = kept(self.spark.createDataFrame([(0, i, q) for i, q in enumerate(queries)], "search_id long, query_id long, text string"))
        layers = self._kept_layers(s)
        scopes: dict[str, DataFrame | None] = dict.fromkeys(layers)
        if pages is not None:
            asked_pages = self.spark.createDataFrame([(p,) for p in pages], "page string")
            on = retrieval.chunks_on_pages(s.evidence, s.observations, s.links, asked_pages).withColumnRenamed("chunk", "id")
            ids = {"chunk": on, "observation": s.links.join(asked_pages, "page", "left_semi").select("id").distinct()}
            scopes = {name: kept(df.join(ids[name], "id", "left_semi").select(F.col("key").alias("id"))) for name, df in layers.items()}
        indexes = self._indexes(s, layers)
        reason = next((x[2] for x in indexes.values() if x[2]), "")
        try:
            vectors = None if reason else kept(asked.select("query_id", self.model.embedded(F.col("text")).alias("vector")))
        except Exception as error:  # whatever a model's call raises
            vectors, reason = None, _reason(error)
        rankings = None
        for name, (postings, held, _) in indexes.items():
            ranked = postings.bm25(asked.select("query_id", "text"), scope=scopes[name]).select("query_id", "id", "rank")
            if vectors is not None:
                near = held if scopes[name] is None else held.join(scopes[name], "id", "left_semi")
                ranked = ranked.union(retrieval.nearest(vectors, near).select("query_id", "id", "rank"))
            placed = ranked.select(F.lit(0).cast("long").alias("search_id"), F.lit(name).alias("layer"), "id", "rank")
            rankings = placed if rankings is None else rankings.union(placed)
        rows, chunks = layers["observation"], layers["chunk"]
        named = retrieval.named_pages(asked.select("query_id", "text"), s.names).select("page").distinct()
        # The bonus of a named page goes to what the search covers.
        told = rows.select("id", "key") if scopes["observation"] is None else rows.select("id", "key").join(scopes["observation"].withColumnRenamed("id", "key"), "key", "left_semi")
        bonus = s.links.join(named, "page").join(told, "id").groupBy("key").agg(F.count("*").alias("pages")).select(F.lit(0).cast("long").alias("search_id"), F.lit("observation").alias("layer"), F.col("key").alias("id"), "pages")
        found = kept(retrieval.layered(rankings, bonus).withColumnRenamed("id", "key"))
        ranked = scoring.score("situational", relevance=F.col("relevance") * scoring.SITUATIONAL_BOOST, reach=F.col("reach"), confidence=F.col("confidence"), source_prior=F.col("source_prior"))
        hits = found.where("layer = 'observation'").join(rows, "key").select("id", "layer", "line", ranked.alias("score"))
        backed = reports.chunk_evidence(chunks.select("id"), s.evidence, fold.current(s.observations))
        kinds = self.entries().select("seq", scoring.source_prior(scoring.source_kind(F.col("kind"), F.col("actor"), F.col("p.kind"))).alias("source_prior"))
        passage = scoring.score("chunk", relevance=F.col("relevance"), reach=F.col("reach"), source_prior=F.col("source_prior"))
        passages = found.where("layer = 'chunk'").join(chunks, "key").join(backed, "id").join(kinds, "seq").select("id", "layer", F.col("context").alias("line"), passage.alias("score"))
        return hits.union(passages).orderBy(F.desc("score"), "id").limit(retrieval.MAX_HITS), reason

    def recall(self, query: str | list[str], budget: int = briefs.RECALL, pages: list[str] | None = None, folder: str | None = None) -> Brief:
        """What the standing brief does not show of what a search finds, then source passages.

        Where nothing can be embedded the hits are those of the words alone, and a notice says why.
        """
        s = self.state()
        standing = set(self.brief(folder=folder, state=s).shown)
        rows = briefs.ranked(fold.current(s.observations), self.now)
        found, reason = self._search(query, s, pages)
        hits = kept(found)
        out = briefs.recall(hits.where("layer = 'observation'"), standing, rows, s.links, s.pages, budget)
        passages = [(r["id"], r["line"]) for r in hits.where("layer = 'chunk'").orderBy(F.desc("score"), "id").collect()]
        notice = f"Keyword matches only; semantic search is unavailable: {reason}" if reason else ""
        return briefs.with_passages(out, passages, budget, notice)

    def open(self, target: str) -> DataFrame:
        """An observation or page by its id, with what belongs to it."""
        s = self.state()
        own = s.observations.where(F.col("id") == target)
        on_page = s.observations.join(s.links.where(F.col("page") == target).select("id"), "id", "left_semi")
        return own.unionByName(on_page).drop("durability").orderBy(F.desc("reach"), F.desc("entered"), "id")

    def history(self, target: str) -> DataFrame:
        """(id, role): what an observation was replaced by, in turn, and all that it replaced."""
        edges = kept(self.state().observations.where("replaced_by is not null").select(F.col("id").alias("node"), F.col("replaced_by").alias("parent")))
        asked = self.spark.createDataFrame([(target,)], "node string")
        before = predecessors(edges, asked).select(F.col("predecessor").alias("id"), F.lit("predecessor").alias("role"))
        after = predecessors(edges.toDF("parent", "node"), asked).select(F.col("predecessor").alias("id"), F.lit("successor").alias("role"))
        return before.union(after)

    def cited(self, view: str) -> DataFrame:
        """The observations that a stored view cites."""
        views = self.views().where(F.col("id") == view).select(F.col("id").alias("view"), "citations")
        return graph_cited(views, self.state().observations.select("id", "line", "seq"))

    def browse(self, limit: int = reports.DEFAULT_PAGE, offset: int = 0) -> DataFrame:
        return reports.page_of(fold.current(self.state().observations).select("id", "line", "reach", "entered"), [F.desc("reach"), F.desc("entered"), F.asc("id")], limit, offset)

    def status(self, attempts: DataFrame) -> DataFrame:
        return fold.entry_status(self.log(), attempts)

    def stats(self) -> DataFrame:
        s = self.state()
        return reports.table_counts({"entries": self.log(), "observations": s.observations, "pages": s.pages, "chunks": s.chunks})

    @staticmethod
    def catalog() -> list[str]:
        """The commands."""
        return sorted(n for n in vars(Memory) if not n.startswith("_"))
