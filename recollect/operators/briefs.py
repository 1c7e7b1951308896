"""Briefs: what to say of a memory within a token budget.

Spark ranks; rows stream to the driver, best first, until nothing more can fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import scoring
from recollect.functions.text import rendered_line, token_estimate, without_brackets
from recollect.operators.budget import AFFINITY_EXPONENT, DIRECTORY_SHARE, NEXT_CAP, Assembly, Brief, Page, estimate
from recollect.operators.graph import ancestors
from recollect.operators.reports import page_inbound
from recollect.operators.tables import kept, numbered

#: Budgets in tokens, the least budget, and the rows of a directory subject.
GLOBAL, PROJECT, RECALL, LEAST, SUBJECT = 8000, 4000, 1500, 200, 3


def ranked(observations: DataFrame, now: Column) -> DataFrame:
    """Current observations with rank, by the standing formula, and their rendered line.

    ``observations`` has id, line, body, entered, happened, durability, the ratings,
    confidence, source_prior and sources.
    """
    day = F.coalesce("happened", "entered")
    v = {n: F.col(n) for n in ("reach", "surprise", "directive", "confidence", "source_prior", "sources")}
    rank = scoring.score("standing", freshness=scoring.freshness(day, now, F.col("durability")), **v) * scoring.STANDING_BOOST
    shown = rendered_line(F.col("id"), scoring.bucket(rank), F.col("body").isNotNull(), F.col("line"), F.col("sources").cast("long"), F.date_format(day, "d MMM"))
    return observations.withColumn("rank", rank).withColumn("shown", shown)


def page_order(rows: DataFrame, links: DataFrame, pages: DataFrame, affinities: DataFrame | None = None) -> DataFrame:
    """``pages`` that hold ranked rows, with best, observations, inbound, score and order."""
    held = links.join(rows.select("id", "rank"), "id")
    stats = held.groupBy("page").agg(F.max("rank").alias("best")).join(page_inbound(held.select("id", "page")), "page")
    score = scoring.score("page", best=F.col("best"), observations=F.col("observations"), inbound=F.col("inbound"))
    scored = pages.join(stats, "page").withColumn("score", score).withColumn("affinity", F.lit(None).cast("double"))
    if affinities is not None:
        scored = scored.drop("affinity").join(affinities.select("page", "affinity"), "page").withColumn("score", F.col("score") * F.col("affinity"))
    return numbered(scored, "order", F.desc_nulls_last("affinity"), F.desc("score"), F.asc("page"))


def directory(rows: DataFrame, links: DataFrame, edges: DataFrame, covered: list[str], budget: int, opened: list[str] | None = None) -> str:
    """Top-level subjects of which nothing was shown, best first, as far as they fit.

    Shown are the ids ``covered`` and all that lie on the pages ``opened``.
    """
    up = ancestors(edges)
    depth = Window.partitionBy("node").orderBy(F.desc("depth"))
    tops = up.withColumn("n", F.row_number().over(depth)).where("n = 1").select(F.col("node").alias("page"), F.col("ancestor").alias("subject"))
    marked = rows.withColumn("covered", F.col("id").isin(covered) if covered else F.lit(False))
    if opened:
        on_opened = links.where(F.col("page").isin(opened)).select("id", F.lit(True).alias("opened")).distinct()
        marked = marked.join(on_opened, "id", "left").withColumn("covered", F.col("covered") | F.coalesce("opened", F.lit(False)))
    rolled = links.join(marked.select("id", "rank", "covered"), "id").join(tops, "page").groupBy("subject")
    rolled = rolled.agg(F.countDistinct("id").alias("n"), F.max("rank").alias("best"), F.bool_or("covered").alias("covered"))
    line = F.concat(F.lit("- "), F.col("subject"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"))
    told = rolled.where(f"not covered and n >= {SUBJECT}").select("subject", "best", line.alias("line")).withColumn("size", token_estimate(F.col("line")))
    # Of lines of equal size the n-th fits only after those before it, so the others stay in Spark.
    place = F.row_number().over(Window.partitionBy("size").orderBy(F.desc("best"), "subject"))
    text, used = "", 0
    for r in told.where(F.col("size") <= budget).withColumn("m", place).where(F.col("m") * F.col("size") <= budget).orderBy(F.desc("best"), "subject").collect():
        if used + r["size"] + (estimate("\n## More\n") if not text else 0) <= budget:
            text, used = (text or "\n## More\n") + r["line"], used + r["size"]
    return text


def brief(rows: DataFrame, links: DataFrame, pages: DataFrame, title: str, budget: int = GLOBAL, affinities: DataFrame | None = None, edges: DataFrame | None = None, hidden: set[str] | None = None) -> Brief:
    """A brief of ranked rows on their pages (page, category, line, parent).

    Of a page's lines of equal size the n-th can be shown only once the n - 1 before it
    are, so those for which n times the size exceeds the budget stay in Spark. The rest
    stream to the choice by rank; once no page can be opened, only lines of open pages.
    """
    budget = max(budget, LEAST)
    ordered = page_order(rows, links, pages, affinities)
    head = F.concat("page", F.lit(" ("), F.coalesce("category", F.lit("None")), F.lit(")"), F.coalesce(F.concat(F.lit(" — "), F.when(F.col("line") != "", F.col("line"))), F.lit("")), F.lit(" ("), F.col("observations").cast("string"), F.lit(")"))
    heads = kept(ordered.select("page", "order", "affinity", head.alias("head"), token_estimate(F.concat(F.lit("##"), head)).alias("head_size")))
    held = links.select("id", "page").distinct().join(rows.select("id", "rank", "entered", "shown"), "id").join(heads, "page")
    place = [F.desc("rank"), F.desc("entered"), "id"]
    lines = kept(held.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy(*place))).withColumn("size", token_estimate(F.col("shown"))))
    fresh = lines.where(~F.col("id").isin(sorted(hidden))) if hidden else lines
    fit = fresh.where(F.col("shown").isNotNull() & (F.col("size") <= budget)).withColumn("m", F.row_number().over(Window.partitionBy("page", "size").orderBy(*place))).where(F.col("m") * F.col("size") <= budget)
    fit = kept(fit.select("rank", "order", "n", "id", "shown", "size", "page", "head", "affinity"))
    least = fit.agg(F.min("size")).first()[0] or budget
    n_pages, least_heading, total = heads.agg(F.count("*"), F.min("head_size"), F.sum(F.pow("affinity", F.lit(AFFINITY_EXPONENT)))).first()
    work = Assembly(budget, title, hidden=hidden, total=total or 0.0)

    def stream(only_open: bool):
        found = fit.where(F.col("order").isin(list(work.chosen))) if only_open else fit
        for r in found.orderBy(F.desc("rank"), "order", "n").toLocalIterator():
            yield r["rank"], r["order"], r["n"], r["id"], r["shown"], r["size"], Page(r["page"], r["head"], [], None, r["affinity"])

    def by_rank():
        last = None
        for row in stream(False):
            last = (-row[0], row[1], row[2])
            yield row
            if work.closed:
                break
        if work.closed:
            yield from (row for row in stream(True) if (-row[0], row[1], row[2]) > last)

    reserve = int(budget * DIRECTORY_SHARE) if edges is not None else 0
    main = budget - reserve
    work.fill(by_rank(), main, main, least=least, least_heading=least_heading or 1)
    opened = sorted(p.slug for p in work.pages.values())
    tail = "" if edges is None else directory(rows, links, edges, [], reserve, opened)
    if reserve and work.chosen:
        work.fill(stream(True), budget - estimate(tail), main, new_pages=False, least=least)
    rest = lines.where(~F.col("id").isin(sorted(work.shown))) if work.shown else lines
    first = F.min(F.struct((-F.col("rank")).alias("rank"), "order", "n"))
    left = [r["id"] for r in rest.groupBy("id").agg(first.alias("first")).orderBy("first").limit(NEXT_CAP).collect()]
    parents: dict[str, str | None] = {}
    ask = set(opened)
    while ask:
        parents |= dict.fromkeys(ask) | {r["page"]: r["parent"] for r in pages.where(F.col("page").isin(sorted(ask))).select("page", "parent").collect()}
        ask = {p for p in parents.values() if p is not None and p not in parents}
    return work.render(tail, parents, left, n_pages)


@dataclass
class Changes:
    """Lines that tell of changes, their tokens, where to go on from, and what did not fit: the first ids and how many."""

    lines: list[str]
    tokens: int
    upto: int
    left: list[str]
    n_left: int


def changes(observations: DataFrame, pages: DataFrame, seq: int, budget: int, last: int | None = None) -> Changes:
    """Changes after ``seq`` in the log's order, first fit.

    ``observations`` has id, line and seq and may have replaced_by and forgotten, which
    are told; ``pages`` has page, line and seq. One goes on from before the first change
    that did not fit, else from ``last``, the last that is told unless given. Every change
    is tried: those too long for the whole budget are only counted, by Spark, the others
    stream until not even the shortest fits.
    """
    marks = [F.concat(F.lit(text), value) if value is not None else F.lit(text) for text, value in ((" → ", F.col("replaced_by")), (" (forgotten)", None))]
    gone = [F.when(F.col(c).isNotNull(), mark) for c, mark in zip(("replaced_by", "forgotten"), marks, strict=True) if c in observations.columns]
    tail = F.concat(*(F.coalesce(x, F.lit("")) for x in gone)) if gone else F.lit("")
    line = lambda name, mark: F.concat(F.lit("- "), F.col(name), mark, F.coalesce(F.concat(F.lit(" "), F.col("line")), F.lit("")), F.lit("\n"))
    told = observations.select("id", "seq", line("id", tail).alias("text")).union(pages.select("page", "seq", line("page", F.lit("")).alias("text")))
    rows = kept(told.where(F.col("seq") > seq).withColumn("size", token_estimate(F.col("text"))))
    least, n = rows.where(F.col("size") <= budget).agg(F.min("size"), F.count("*")).first()
    lines, ids, used, upto = [], [], 0, seq
    for r in rows.where(F.col("size") <= budget).orderBy("seq", "id").toLocalIterator() if n else ():
        if used + least > budget:
            break
        if used + r["size"] <= budget:
            lines, ids, used, upto = [*lines, r["text"]], [*ids, (r["seq"], r["id"])], used + r["size"], max(upto, r["seq"])
    shown = rows.sparkSession.createDataFrame(ids, "seq long, id string")
    rest = rows.join(F.broadcast(shown), ["seq", "id"], "left_anti")
    n_left, first = rest.agg(F.count("*"), F.min("seq")).first()
    left = [r["id"] for r in rest.orderBy("seq", "id").limit(NEXT_CAP).collect()]
    upto = upto if last is None else max(upto, last)
    return Changes(lines, used, upto if first is None else min(upto, max(seq, first - 1)), left, n_left)


def since(observations: DataFrame, pages: DataFrame, seq: int, budget: int) -> tuple[list[str], int]:
    """The lines of ``changes`` and where to go on from."""
    told = changes(observations, pages, seq, budget)
    return told.lines, told.upto


# Tokens of the timeline's parts.
HISTORY, RECENT, OPEN = 1000, 800, 400


def timeline(views: DataFrame, observations: DataFrame, latest: int, excluded: set[str] | None = None, history: int = HISTORY, recent: int = RECENT, open_: int = OPEN) -> tuple[str, str, list[str], bool]:
    """History, recent days, the ids that open days show, and whether anything was left out.

    ``views`` (id, kind, text, headline, start) are those that cover the past, at most a
    calendar of them. Months and years tell their text, the oldest only their headline
    where the budget asks for it, or nothing; days and weeks tell headlines. Current
    ``observations`` (id, line, seq, day) after ``latest`` are taken newest first as far
    as they fit, and read only as far as one could fit.
    """
    rows = views.where("trim(coalesce(text, '')) != ''").select("id", "kind", without_brackets(F.col("text")).alias("text"), without_brackets(F.coalesce("headline", F.lit(""))).alias("headline")).orderBy("start", "id").collect()
    old, new = ([r for r in rows if (r["kind"] in ("month", "year")) == far] for far in (True, False))
    lines = [f"- {r['id']} {r['text']}" for r in old]
    size = lambda head, parts: estimate("\n".join([head, *parts]))
    for i, r in enumerate(old):
        if size("## History", lines) <= history:
            break
        lines[i] = f"- {r['id']} {r['headline']}"
    left_out = False
    while lines and size("## History", lines) > history:
        lines, left_out = lines[1:], True
    told = "\n".join(["## History", *lines]) if lines else ""

    shown: list[str] = []
    opened = "### Open days"
    fresh = observations.where(F.col("seq") > latest)
    fresh = fresh.where(~F.col("id").isin(sorted(excluded))) if excluded else fresh
    line = F.concat(F.lit("\n- "), "id", F.lit(" "), "line", F.coalesce(F.concat(F.lit(" ("), F.col("day").cast("string"), F.lit(")")), F.lit("")))
    sized = kept(fresh.select("id", "seq", line.alias("shown"), token_estimate(line).alias("size")).where(F.col("size") <= open_))
    least = sized.agg(F.min("size")).first()[0]
    n = sized.count() if least is not None else 0
    for r in sized.orderBy(F.desc("seq"), "id").toLocalIterator() if n else ():
        if estimate(opened) + least > open_:
            break
        if estimate(opened) + r["size"] <= open_ and estimate("## Recent\n" + opened + r["shown"]) <= recent:
            opened += r["shown"]
            shown.append(r["id"])
    left_out = left_out or len(shown) < fresh.count()
    heads = [f"- {r['id']} {r['headline']}" for r in new]
    tail = [opened] if shown else []
    while heads and size("## Recent", [*heads, *tail]) > recent:
        heads, left_out = heads[1:], True
    return told, "\n".join(["## Recent", *heads, *tail]) if heads or tail else "", shown, left_out


def with_passages(out: Brief, passages: list[tuple[str, str]], budget: int, notice: str = "") -> Brief:
    """A recall with a notice and, as far as they fit, the source passages (id, line), best first.

    The first passage that does not fit ends them.
    """
    for i, text in enumerate([notice and f"\n\n{notice}", *(("\n\n## Source passages" if k == 0 else "") + f"\n- {id_} {line}" for k, (id_, line) in enumerate(passages))]):
        if not text:
            continue
        if out.tokens + estimate(text) > budget:
            out.truncated = True
            if i:
                break
            continue
        out.text, out.tokens = out.text + text, out.tokens + estimate(text)
    return out


def recall(hits: DataFrame, standing: set[str], rows: DataFrame, links: DataFrame, pages: DataFrame, budget: int = RECALL) -> Brief:
    """Found observations that the standing brief does not show yet, on pages ordered by their best hit.

    ``hits`` has id and score, at most as many as a search returns.
    """
    found = rows.join(hits.select("id", "score"), "id").withColumn("rank", F.col("score"))
    affinities = links.join(found.select("id", "rank"), "id").groupBy("page").agg(F.max("rank").alias("affinity"))
    out = brief(found.where(~F.col("id").isin(sorted(standing))) if standing else found, links, pages, "", budget, affinities)
    again = [r["id"] for r in hits.select("id").collect() if r["id"] in standing]
    note = f"\nAlready shown: {', '.join(again)}\n" if again else ""
    if note and out.tokens + estimate(note) <= budget:
        out.text, out.tokens = out.text + note, out.tokens + estimate(note)
    return out
