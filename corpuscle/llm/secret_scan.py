"""Secret scans by corpus-wide ownership frequency, in DataFrame functions alone.

Base spans (assign, access, hex) are found in every whole text. Long tokens that mix digits, capitals and small letters are
further candidates. The hash of each candidate's value is counted over the corpus by distinct owners and repositories. A
value of at least `copied` owners and `repos` repositories is a widely copied example. Any other looks live: repositories are
told apart by a name that copies of one share, so a value that many owners hold in copies of one repository is a credential that
went along with it, and one that a single owner holds in many repositories is that owner's. Base spans always stay; further
tokens are added as spans of kind `live` if they look live and touch no base span.

Positions are code points, ends exclusive. Null and empty texts have no span. Null owners and repositories count as one.
Repeated rows get repeated results and add no owner; an empty table gives an empty one; other columns are not read (scan)
or carried along (redact), whatever their names. Work is in proportion to a text and its matches: matches are placed by
running sums in blocks, and texts are cut by blocks of code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import join_counted, materialize, unused

#: The base patterns; only the letters of the first may be in either case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "live")
LIVE = r"[A-Za-z0-9+/_-]{20,}"
#: Owners, and repositories, from which a value counts as widely copied.
COPIED, REPOS = 3, 2
#: Values in a block of a running sum; code points in a block of a text.
BLOCK, CHARS = 256, 256

_SPAN = "array<struct<s:int,k:int,e:int,h:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """join of all values up to each. Only blocks and the totals of blocks are grown value by value."""
    none = F.array().cast("array<int>")
    last = lambda a: F.get(a, F.size(a) - 1)

    def grown(part: Column) -> Column:
        return F.aggregate(part, none, lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, join(last(a), x)).otherwise(x))))

    def joined(blocks: Column, totals: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: F.when(i > 0, join(F.get(totals, i - 1), x)).otherwise(x))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: grown(F.slice(v, k * BLOCK + 1, BLOCK)))
        return F.when(F.size(v) == 0, none).otherwise(_once(blocks, lambda b: _once(grown(F.transform(b, last)), lambda t: joined(b, t))))

    return _once(values, whole)


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches that don't overlap, without those whose group is shorter than least; v is the group.

    What lies between matches gives their places, since functions return matches without places.
    """
    found = F.arrays_zip(F.split(text, pattern, -1).alias("b"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    sized = F.transform(found, lambda x: F.struct((F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("step"), F.length(x["m"]).alias("m"), x["v"].alias("v")))

    def placed(x: Column) -> Column:
        ends = running(F.transform(x, lambda y: y["step"]), lambda a, b: a + b)
        long = F.filter(F.arrays_zip(x.alias("x"), ends.alias("e")), lambda y: F.length(y["x"]["v"]) >= least)
        return F.transform(long, lambda y: F.struct((y["e"] - y["x"]["m"]).alias("s"), F.lit(kind).alias("k"), y["e"].alias("e"), y["x"]["v"].alias("v")))

    return _once(sized, placed)


def _hashed(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.sha2(x["v"], 256).alias("h")))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind. A cheap test keeps texts without a match from the exact patterns."""
    small = F.lower(text)
    words = reduce(lambda a, b: a | b, (small.contains(w) for w in ("passw", "secret", "token", "api")))
    found = [
        F.when(words & text.rlike(ASSIGN.removesuffix("+)") + "{12,})"), _hashed(_spans(text, 0, ASSIGN, 2, 12))).otherwise(_none()),
        F.when(text.contains("AKIA") & text.rlike(ACCESS[:-1] + "{14,}"), _hashed(_spans(text, 1, ACCESS, 0, 18))).otherwise(_none()),
        # runs don't touch, so the long ones alone are the matches that stay
        F.when(text.rlike(HEX[:-1] + "{16,}"), _hashed(_spans(text, 2, HEX[:-1] + "{16,}", 0, 16))).otherwise(_none()),
    ]
    return F.array_sort(F.concat(*found))


def _apart(own: Column, base: Column) -> Column:
    """The spans of own that touch none of base, by one walk over both in the order of their starts."""

    def walked(x: Column) -> Column:
        most = F.lit(2**31 - 1)
        before = running(F.transform(x, lambda y: F.when(y["k"] < 3, y["e"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        after = F.reverse(running(F.transform(F.reverse(x), lambda y: F.when(y["k"] < 3, y["s"]).otherwise(most)), lambda a, b: F.least(a, b)))
        alone = F.filter(F.arrays_zip(x.alias("x"), before.alias("a"), after.alias("b")), lambda y: (y["x"]["k"] == 3) & (y["a"] <= y["x"]["s"]) & (y["b"] >= y["x"]["e"]))
        return F.transform(alone, lambda y: y["x"])

    return F.when((F.size(own) == 0) | (F.size(base) == 0), own).otherwise(_once(F.array_sort(F.concat(base, own)), walked))


def live_candidates(text: Column, base: Column) -> Column:
    """Long mixed tokens that touch no base span."""
    mixed = lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Z]") & x["v"].rlike("[a-z]")
    own = F.when(text.rlike(LIVE), _hashed(F.filter(_spans(text, 3, LIVE, 0, 20), mixed))).otherwise(_none())
    return _once(own, lambda x: _apart(x, base))


def candidates(text: Column) -> Column:
    """All candidates of a text."""
    return _once(base_spans(text), lambda b: F.concat(b, live_candidates(text, b)))


def ownership(found: DataFrame) -> DataFrame:
    """h, rows, owners and repositories of each value; found: h, owner, repo.

    Rows are counted before the shuffle, and a value has at most a row for each owner and repository after it.
    """
    each = found.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    return each.groupBy("h").agg(F.sum("n").alias("n"), F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repos"))


def classified(rows: DataFrame, copied: int, repos: int) -> DataFrame:
    """rows: rid, owner, repo, found. For each rid with candidates all spans that stay, as found, each with its class."""
    empty = F.lit("")
    each = rows.where(F.size("found") > 0).select("rid", F.coalesce("owner", empty).alias("owner"), F.coalesce("repo", empty).alias("repo"), F.explode("found").alias("c")).select("rid", "owner", "repo", "c.*")
    owned = materialize(ownership(each), "ownership")
    total = owned.agg(F.sum("n")).first()[0] or 0
    joined = join_counted(each.select("rid", "s", "k", "e", "h"), owned, ["h"], "n", total)
    joined = joined.withColumn("copied", (F.col("n_owners") >= copied) & (F.col("n_repos") >= repos))
    stay = joined.where((F.col("k") < 3) | ~F.col("copied"))
    return stay.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "copied", "n_owners", "n_repos"))).alias("found"))


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _is(k: int) -> Callable[[Column], Column]:
    return lambda x: x["k"] == k


def scan(docs: DataFrame, owner_col: str = "source", repo_col: str | Column = "source", id_col: str = "doc_id", text_col: str = "text", copied: int = COPIED, repos: int = REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans; then n_live and n_copied (spans whose value looks live, or is
    copied) and owners: the owners and repositories of each span's value, as spans are listed."""
    repo = F.col(repo_col) if isinstance(repo_col, str) else repo_col
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), repo.cast("string").alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the row number is written with the row, so it holds whatever runs again later
    rows = materialize(given.select("doc_id", "owner", "repo", candidates(F.col("text")).alias("found"), F.monotonically_increasing_id().alias("rid")), "candidates")
    stay = classified(rows, copied, repos)
    one = "array<struct<s:int,k:int,e:int,copied:boolean,n_owners:bigint,n_repos:bigint>>"
    none = rows.where(F.size("found") == 0).select("doc_id", F.array().cast(one).alias("found"))
    some = rows.where(F.size("found") > 0).select("rid", "doc_id").join(stay, "rid", "left").select("doc_id", F.coalesce("found", F.array().cast(one)).alias("found"))
    found, base = F.col("found"), F.filter("found", lambda x: x["k"] < 3)
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    return none.unionByName(some).select(
        "doc_id",
        *(count(_is(k)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(found).alias("spans"),
        count(lambda x: ~x["copied"]).alias("n_live"),
        count(lambda x: x["copied"]).alias("n_copied"),
        F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["n_owners"].cast("string"), x["n_repos"].cast("string"))), ",").alias("owners"),
    )


def blanked(text: Column, spans: Column, mark: str) -> Column:
    """text with mark for each of spans, which are sorted; of overlapping ones, for all of them together."""

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b of the text in blocks."""
        first, last = F.floor(a / CHARS).cast("int"), F.floor((b - 1) / CHARS).cast("int")
        one = lambda k: F.get(blocks, k)
        within = F.substring(one(first), F.pmod(a, F.lit(CHARS)) + 1, b - a)
        across = F.concat(F.substring(one(first), F.pmod(a, F.lit(CHARS)) + 1, F.lit(CHARS)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(one(last), F.lit(1), b - last * CHARS))
        return F.when(b <= a, "").when(first == last, within).otherwise(across)

    def pieces(x: Column, until: Column, blocks: Column) -> Column:
        """What lies before each span that no earlier one reaches, and after the last."""
        at = F.arrays_zip(x.alias("x"), F.slice(F.concat(F.array(F.lit(0)), until), 1, F.size(x)).alias("a"))
        kept = F.transform(F.filter(at, lambda y: y["x"]["s"] >= y["a"]), lambda y: cut(blocks, y["a"], y["x"]["s"]))
        return F.array_join(F.concat(kept, F.array(cut(blocks, F.get(until, F.size(until) - 1), F.length(text)))), mark)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))
    return _once(spans, lambda x: _once(running(F.transform(x, lambda y: y["e"]), lambda a, b: F.greatest(a, b)), lambda u: _once(blocks, lambda t: pieces(x, u, t))))


def redact(docs: DataFrame, owner_col: str = "source", repo_col: str | Column = "source", text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]", copied: int = COPIED, repos: int = REPOS) -> DataFrame:
    """docs with every span that looks live replaced by mark; widely copied examples stay.

    Only rows with candidates are joined with what the corpus says of them; all other rows pass where they are.
    """
    found, rid, own, spans = unused(docs, "found", "rid", "repo", "spans")
    repo = F.col(repo_col) if isinstance(repo_col, str) else repo_col
    marked = docs.withColumn(found, candidates(F.coalesce(F.col(text_col), F.lit(""))))
    clean = marked.where(F.size(found) == 0).select(*(f"`{c}`" for c in docs.columns))
    some = materialize(marked.where(F.size(found) > 0).withColumn(rid, F.monotonically_increasing_id()).withColumn(own, repo.cast("string")), "suspects")
    rows = some.select(F.col(rid).alias("rid"), F.col(owner_col).cast("string").alias("owner"), F.col(own).alias("repo"), F.col(found).alias("found"))
    stay = classified(rows, copied, repos).select(F.col("rid").alias(rid), F.filter("found", lambda x: ~x["copied"]).alias(spans))
    new = F.when(F.size(spans) > 0, blanked(F.col(text_col), F.col(spans), mark)).otherwise(F.col(text_col))
    out = some.join(stay, rid, "left").withColumn(text_col, new)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(F.col(text_col)).cast(docs.schema[chars_col].dataType))
    return clean.unionByName(out.select(*(f"`{c}`" for c in docs.columns)))
