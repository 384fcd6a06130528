"""Text search: plans -> matching chunks -> scored files -> ranked page, as one lazy DataFrame.

Chunks are filtered before the joins that fan them out to files, and the text is dropped right after the predicates, so
only keys are shuffled. Branch tables are small next to files; Spark broadcasts them by their size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import content_predicate, path_matches
from ..index import Index
from ..plans.language import Plan, Request
from .textindex import candidates, chunk_id


def live_commits(ix: Index) -> DataFrame:
    """(repository, commit_sha) that a live branch points at, by its head or a snapshot."""
    heads = ix.branches.select("repository", "branch", "commit_sha").unionByName(ix.snapshots.select("repository", "branch", "commit_sha"))
    return heads.join(ix.live.select("repository", "branch"), ["repository", "branch"], "left_semi").select("repository", "commit_sha").distinct()


def live_repositories(ix: Index) -> DataFrame:
    """Repositories that have branches or a live branch."""
    return ix.branches.select("repository").union(ix.live.select("repository")).distinct()


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def chunk_filter(plan: Plan, text: Column) -> Column:
    """All required terms and none of the excluded ones in the same chunk. The longest plain term goes first: it is the
    likeliest to settle a chunk cheaply."""
    s = plan.case_sensitive
    required = sorted(plan.required, key=lambda t: (t.regex, -len(t.text)))
    return _all([content_predicate(text, t, s) for t in required] + [~content_predicate(text, t, s) for t in plan.excluded])


def file_filter(plan: Plan) -> Column:
    tests = []
    if plan.repos:
        tests.append(F.col("repository").isin(*plan.repos))
    if plan.no_repos:
        tests.append(~F.col("repository").isin(*plan.no_repos))
    tests += [path_matches(F.col("file_path"), g) for g in plan.globs]
    tests += [~path_matches(F.col("file_path"), g) for g in plan.no_globs]
    return _all(tests)


def on_branches(ix: Index, files: DataFrame, branches: tuple[str, ...], negated: bool = False) -> DataFrame:
    """Files whose commit is one of the names, or the head or a snapshot of a branch of such a name."""
    heads = ix.branches.select("repository", "branch", "commit_sha").unionByName(ix.snapshots.select("repository", "branch", "commit_sha"))
    named = heads.filter(F.col("branch").isin(*branches)).select("repository", "commit_sha").distinct().withColumn("on_branch", F.lit(True))
    hit = F.col("commit_sha").isin(*branches) | F.col("on_branch").isNotNull()
    return files.join(named, ["repository", "commit_sha"], "left").filter(~hit if negated else hit).drop("on_branch")


def live_only(ix: Index, files: DataFrame) -> DataFrame:
    """Files at a live commit, and all files of repositories that aren't known to have branches."""
    repos = live_repositories(ix).withColumn("known", F.lit(True))
    commits = live_commits(ix).withColumn("at_live", F.lit(True))
    return files.join(repos, "repository", "left").join(commits, ["repository", "commit_sha"], "left").filter(F.col("known").isNull() | F.col("at_live").isNotNull()).drop("known", "at_live")


def plan_files(ix: Index, plan: Plan) -> DataFrame:
    files = ix.files.filter(file_filter(plan))
    if plan.langs or plan.no_langs:
        tests = [F.col("language").isin(*plan.langs)] if plan.langs else []
        if plan.no_langs:  # a file without a language goes too
            tests.append(~F.col("language").isin(*plan.no_langs))
        files = files.join(ix.blobs.filter(_all(tests)).select(F.col("hash").alias("content_hash")), "content_hash")
    if plan.branches:
        files = on_branches(ix, files, plan.branches)
    if plan.no_branches:
        files = on_branches(ix, files, plan.no_branches, negated=True)
    if not plan.branches and not plan.historical:
        files = live_only(ix, files)
    return files


def candidate_chunks(ix: Index, plans: list[Plan]) -> DataFrame:
    """Chunks that may match a plan: by the trigram index, where there is one and each plan has a term that it knows."""
    found = candidates(ix.postings, plans) if ix.postings is not None else None
    if found is None:
        return ix.chunks
    return ix.chunks.withColumn("chunk_id", chunk_id()).join(found, "chunk_id", "left_semi").drop("chunk_id")


def tested_places(ix: Index, plans: list[Plan], test: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Places of the chunks that test keeps, with what it adds to them. Where places come with their texts, they are tested
    there, and no text is shuffled."""
    if ix.places is not None:
        return test(ix.places).drop("text_content")
    chunks = test(candidate_chunks(ix, plans)).drop("text_content")
    return ix.mapping.select("content_hash", "chunk_hash", "chunk_index").join(chunks, "chunk_hash")


def plan_matches(ix: Index, plan: Plan) -> DataFrame:
    """One row for each matching chunk of each file of the plan."""
    if ix.places is None and plan.repos and not any(t.regex for t in plan.required):
        # few files are known beforehand: their chunks alone are read
        files = plan_files(ix, plan)
        places = ix.mapping.join(files.select("content_hash").distinct(), "content_hash", "left_semi")
        ix = replace(ix, mapping=places, chunks=ix.chunks.join(places.select("chunk_hash").distinct(), "chunk_hash", "left_semi"))
    places = tested_places(ix, [plan], lambda rows: rows.filter(chunk_filter(plan, F.col("text_content"))))
    out = places.join(plan_files(ix, plan), "content_hash")
    return out.select(
        "file_id", "repository", "commit_sha", "file_path", "content_hash", "chunk_hash", "chunk_index",
        F.lit(plan.highlight).alias("highlight_pattern"), F.lit(plan.case_sensitive).alias("highlight_case_sensitive"), F.lit(bool(plan.historical)).alias("include_historical"),
    )


def matches(ix: Index, request: Request, capped: bool = False) -> DataFrame:
    """All plans' matches; what two plans match counts twice. capped: at most plan_rows rows of each plan and fetch_limit in
    all, the first by (file_id, chunk_index)."""
    if not capped:
        return plan_matches(ix, request.plans[0]) if len(request.plans) == 1 else plans_matches(ix, list(request.plans))
    parts = [plan_matches(ix, p).orderBy("file_id", "chunk_index").limit(request.plan_rows) for p in request.plans]
    return reduce(DataFrame.unionByName, parts).orderBy("file_id", "chunk_index", "highlight_pattern").limit(request.fetch_limit)


def _numbers(tests: list[Column]) -> Column:
    """The numbers of the tests that hold."""
    return F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in enumerate(tests))))


def plans_matches(ix: Index, plans: list[Plan]) -> DataFrame:
    """plan_matches of several plans by one scan of chunks, of places and of files: each chunk and each file carries the
    plans whose tests it passes, and they meet by plan."""
    texts = list(dict.fromkeys((p.required, p.excluded, p.case_sensitive) for p in plans))
    first = [next(p for p in plans if (p.required, p.excluded, p.case_sensitive) == t) for t in texts]
    of_text = [texts.index((p.required, p.excluded, p.case_sensitive)) for p in plans]
    held = _numbers([chunk_filter(p, F.col("text_content")) for p in first])
    places = tested_places(ix, first, lambda rows: rows.withColumn("held", held).filter(F.size("held") > 0))
    files = ix.files
    if any(p.langs or p.no_langs for p in plans):
        files = files.join(ix.blobs.select(F.col("hash").alias("content_hash"), "language"), "content_hash", "left")
    names = sorted({b for p in plans for b in (*p.branches, *p.no_branches)})
    if names:
        heads = ix.branches.select("repository", "branch", "commit_sha").unionByName(ix.snapshots.select("repository", "branch", "commit_sha"))
        files = files.join(heads.filter(F.col("branch").isin(*names)).groupBy("repository", "commit_sha").agg(F.collect_set("branch").alias("on")), ["repository", "commit_sha"], "left")
    if any(not p.branches and not p.historical for p in plans):
        files = files.join(live_repositories(ix).withColumn("known", F.lit(True)), "repository", "left").join(live_commits(ix).withColumn("at_live", F.lit(True)), ["repository", "commit_sha"], "left")

    def on(branches: tuple[str, ...]) -> Column:
        return F.col("commit_sha").isin(*branches) | F.coalesce(F.arrays_overlap("on", F.array(*map(F.lit, branches))), F.lit(False))

    def file_test(p: Plan) -> Column:
        tests = [file_filter(p)]
        tests += [F.col("language").isin(*p.langs)] if p.langs else []
        tests += [~F.col("language").isin(*p.no_langs)] if p.no_langs else []
        tests += [on(p.branches)] if p.branches else []
        tests += [~on(p.no_branches)] if p.no_branches else []
        tests += [F.col("known").isNull() | F.col("at_live").isNotNull()] if not p.branches and not p.historical else []
        return _all(tests)

    files = files.select("file_id", "repository", "commit_sha", "file_path", "content_hash", _numbers([file_test(p) for p in plans]).alias("passed")).filter(F.size("passed") > 0)
    both = places.join(files, "content_hash").withColumn("plan", F.explode("passed"))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("plan") + 1)
    out = both.filter(F.array_contains("held", of(of_text)))
    return out.select(
        "file_id", "repository", "commit_sha", "file_path", "content_hash", "chunk_hash", "chunk_index",
        of([p.highlight for p in plans]).alias("highlight_pattern"), of([p.case_sensitive for p in plans]).alias("highlight_case_sensitive"), of([bool(p.historical) for p in plans]).alias("include_historical"),
    )


KEYS = ["file_id", "content_hash", "include_historical"]


def score_files(rows: DataFrame) -> DataFrame:
    """Chunks that match, doubly if the case had to."""
    weight = F.when(F.col("highlight_case_sensitive"), 2).otherwise(1)
    return rows.groupBy(KEYS).agg(F.sum(weight).alias("score"), F.min("chunk_index").alias("min_chunk_index"))


def terms_table(ix: Index, terms: list[str]) -> DataFrame:
    return F.broadcast(ix.files.sparkSession.createDataFrame([(t,) for t in terms], "term string"))  # a query's own words


def among(rows: DataFrame, contents: DataFrame | None) -> DataFrame:
    return rows if contents is None else rows.join(contents.select("content_hash").distinct(), "content_hash", "left_semi")


def symbols_like(ix: Index, terms: list[str], contents: DataFrame | None = None) -> DataFrame:
    """(content_hash, name_lc, term) of symbols that hold a term; an underscore in a term is a wildcard."""
    names = among(ix.symbols.select("content_hash", "name_lc"), contents)
    return names.join(terms_table(ix, terms), F.like("name_lc", F.concat(F.lit("%"), "term", F.lit("%"))))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def symbol_scores(ix: Index, terms: list[str]) -> DataFrame:
    """(content_hash, symbol_score): a symbol equal to a term counts most, then one of its namespace, then likeness. The
    terms are literals, so that the scan of the symbols filters by them, in one pass whatever their number."""
    n = F.col("name_lc")
    like = [F.like(n, F.lit(f"%{t}%")) for t in terms]
    value = [F.when(n == t, 50.0).when(F.like(n, F.lit(f"{t}::%")), 25.0).when(hit, F.lit(1.0) / (1 + F.abs(F.length(n) - len(t)))) for t, hit in zip(terms, like, strict=True)]
    return ix.symbols.filter(_any(like)).groupBy("content_hash").agg(F.max(F.array_max(F.array(*value))).alias("symbol_score"))


def definition_scores(ix: Index, terms: list[str]) -> DataFrame:
    """(content_hash, definition_matches): 2 if a term is defined, 1 if a name that begins with it is. Symbols are stored in
    the order of their names, so that few row groups are read."""
    n = F.col("name_lc")
    found = ix.occurrences().filter(_any([(n == t) | F.like(n, F.lit(f"{t}%")) for t in terms]) & (F.col("kind") == "definition")).select("content_hash", n.isin(*terms).alias("same"))
    return found.groupBy("content_hash").agg(F.max(F.when(F.col("same"), 2).otherwise(1)).alias("definition_matches"))


FIRST = ["chunk_index", "highlight_pattern", "chunk_hash", "highlight_case_sensitive", "repository", "commit_sha", "file_path"]


def top_files(ix: Index, rows: DataFrame, request: Request) -> DataFrame:
    """Each file with its score and its first matching chunk (FIRST columns), by one aggregate over the matches."""
    weight = F.when(F.col("highlight_case_sensitive"), 2).otherwise(1)
    scored = rows.groupBy(KEYS).agg(F.sum(weight).alias("score"), F.min(F.struct(*FIRST)).alias("first"))
    extra, defs = F.lit(0.0), F.lit(0)
    if request.symbol_terms:
        scored = scored.join(symbol_scores(ix, request.symbol_terms), "content_hash", "left")
        extra = F.coalesce("symbol_score", F.lit(0.0))
        if request.definition_terms:
            scored = scored.join(definition_scores(ix, request.definition_terms), "content_hash", "left")
            defs = F.coalesce("definition_matches", F.lit(0))
    return scored.select(*KEYS, (F.col("score").cast("double") + extra).alias("total_score"), defs.alias("definition_matches"), "first.*")


def first_chunks(rows: DataFrame) -> DataFrame:
    """Each file's first matching chunk; ties between plans go by the highlight pattern."""
    w = Window.partitionBy(KEYS).orderBy("chunk_index", "highlight_pattern")
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def branch_columns(ix: Index) -> DataFrame:
    """For each (repository, commit_sha) of a branch: branches with such a snapshot, else such a head; live ones of these
    likewise; the last snapshot's time. One aggregate over the branches that have files: others are let go before it."""
    columns = ["repository", "branch", "commit_sha", "indexed_at"]
    every = ix.snapshots.select(*columns, F.lit(True).alias("snap")).unionByName(ix.branches.select(*columns, F.lit(False).alias("snap")))
    every = every.join(ix.files.select("repository", "commit_sha").distinct(), ["repository", "commit_sha"], "left_semi")
    every = every.join(ix.live.select("repository", "branch").distinct().withColumn("on", F.lit(True)), ["repository", "branch"], "left")

    def names(test: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(test, F.col("branch"))))

    snap, on = F.col("snap"), F.col("on").isNotNull()
    out = every.groupBy("repository", "commit_sha").agg(names(snap).alias("b1"), names(~snap).alias("b2"), names(snap & on).alias("l1"), names(~snap & on).alias("l2"), F.max(F.when(snap, F.col("indexed_at"))).alias("snapshot_indexed_at"))
    first = lambda a, b: F.when(F.size(a) > 0, F.col(a)).otherwise(F.col(b))
    return out.select("repository", "commit_sha", first("b1", "b2").alias("branches"), first("l1", "l2").alias("live_branches"), "snapshot_indexed_at")


def result_order() -> list[Column | str]:
    return [F.desc("definition_matches"), F.desc("total_score"), "repository", "commit_sha", "file_path", "chunk_index", "file_id"]


def ranked(ix: Index, request: Request, capped: bool = False) -> DataFrame:
    """Every file that the request finds, with its score and branches, unordered."""
    out = top_files(ix, matches(ix, request, capped), request)
    if capped:
        out = out.orderBy(F.desc("definition_matches"), F.desc("total_score"), "chunk_index", "file_id").limit(request.file_limit)
    out = out.join(branch_columns(ix), ["repository", "commit_sha"], "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("branches", "live_branches")})
    out = out.withColumn("is_historical", F.size("live_branches") == 0)  # no live branch is at the commit
    return out.filter(F.col("include_historical") | (F.size("live_branches") > 0) | (F.size("branches") > 0))


RESULT = ["file_id", "repository", "commit_sha", "file_path", "content_hash", "chunk_index", "total_score", "definition_matches", "branches", "live_branches", "is_historical"]


def search(ix: Index, request: Request, capped: bool = False) -> DataFrame:
    """One page of results in order, with the position from 1."""
    rows = ranked(ix, request, capped).orderBy(*result_order()).limit(request.offset + request.page_size)
    w = Window.partitionBy(F.lit(0)).orderBy(*result_order())  # a page's rows, not the corpus
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") > request.offset)


def has_more(ix: Index, request: Request, capped: bool = False) -> DataFrame:
    """(total, has_more) of a request. capped: there may be more, too, if matches were as many as the fetch limit."""
    total = ranked(ix, request, capped).agg(F.count("*").alias("total"))
    more = F.col("total") > request.offset + request.page_size
    if not capped:
        return total.withColumn("has_more", more)
    full = matches(ix, request, capped).count() >= request.fetch_limit
    return total.select("total", (more | ((F.col("total") > 0) & F.lit(full))).alias("has_more"))
