"""Secrets in whole texts, by built-in functions alone, with linking of multipart credentials.

Base kinds are assignments, access identifiers and long hexadecimal runs. Beside them the scan gathers weak
parts, which mean nothing alone: account names, short values of secret assignments, and endpoints. All parts of a
text are placed by the lengths of the matches and of the gaps between them. The interval join pairs
each weak part with the nearest identifier and the nearest secret before and after it: a part whose gap
is within the scope is linked. It is written as two windows over the parts in order of position, so no
pair of parts is ever made, and a text with many parts costs its sorted length. A weak identifier is
reported when a secret is in its scope, a weak secret when an identifier is, an endpoint when both are.

Only the lengths of the parts, not the texts, are stored and shuffled.

Defined results: a null or empty text has no spans; each repeated row and each null id gives a row of its
own; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.text import id_and_text
from filigree.session import materialize

#: Code points between two parts of one credential.
SCOPE = 200


def any_case(words: list[str]) -> str:
    """Alternatives whose ASCII letters match in either case."""
    return "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in w) for w in words)


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Kind:
    """Pattern and rank of a kind. `least` and `most` bound the length of `group`; others are dropped."""

    name: str
    pattern: str
    group: int
    least: int
    most: int | None
    role: str
    base: bool


_SECRET = f"({any_case(['password', 'passwd', 'secret', 'token', 'api_?key'])}){_GIVEN}([A-Za-z0-9+/_.=-]+)"
_ACCOUNT = f"({any_case(['user_?name', 'user_?id', 'user', 'login', 'client_?id', 'account'])}){_GIVEN}([A-Za-z0-9@._-]+)"
_ENDPOINT = r"""(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://([^\x20\x09-\x0D"'<>]+)"""

KINDS = [
    Kind("assign", _SECRET, 2, 12, None, "secret", True),
    Kind("access", "AKIA[A-Z0-9]+", 0, 18, None, "identifier", True),
    Kind("hex", "[0-9a-f]+", 0, 16, None, "", True),
    Kind("account", _ACCOUNT, 2, 3, None, "identifier", False),
    Kind("weak", _SECRET, 2, 4, 11, "secret", False),
    Kind("endpoint", _ENDPOINT, 2, 3, None, "endpoint", False),
]
#: Runs shorter than this need no place: the pattern that is run leaves them in the gaps.
PATTERNS = {"hex": "[0-9a-f]{16,}"}


def _lengths(text: Column, pattern: str, group: int) -> Column:
    """Gap before, length, and length of the group of every match, in order; null without a match."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def row(gap: Column, match: Column) -> Column:
        value = F.length(F.regexp_extract(match, pattern, group)) if group else F.length(match)
        return F.struct(F.length(gap).alias("gap"), F.length(match).alias("len"), value.alias("value"))

    found = F.filter(F.zip_with(gaps, matches, row), lambda x: x["len"].isNotNull())
    return F.when(text.rlike(pattern), found)


def _placed(stored: DataFrame) -> DataFrame:
    """rid, kind number, start, end of every part that its kind keeps."""
    patterns = list(dict.fromkeys(PATTERNS.get(k.name, k.pattern) for k in KINDS))
    parts = None
    for n, pattern in enumerate(patterns):
        rows = stored.where(F.col(f"m{n}").isNotNull()).select("rid", F.lit(n).alias("p"), F.posexplode(f"m{n}").alias("pos", "x"))
        parts = rows if parts is None else parts.union(rows)
    before = Window.partitionBy("rid", "p").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.col("x.len")).over(before)
    placed = parts.select("rid", "p", "x.len", "x.value", end.alias("end")).withColumn("start", F.col("end") - F.col("len"))
    number = F.lit(None).cast("int")
    for k, kind in enumerate(KINDS):
        fits = (F.col("p") == patterns.index(PATTERNS.get(kind.name, kind.pattern))) & (F.col("value") >= kind.least)
        fits = fits & (F.col("value") <= kind.most) if kind.most else fits
        number = F.when(fits, k).otherwise(number)
    return placed.withColumn("k", number).where("k is not null").select("rid", "k", "start", "end")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The parts that stay: all base ones, and weak ones whose complements lie in their scope."""
    order = Window.partitionBy("rid").orderBy("start", "k", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)

    def near(role: str) -> Column:
        has = F.col("k").isin([k for k, kind in enumerate(KINDS) if kind.role == role])
        gap_before = F.col("start") - F.max(F.when(has, F.col("end"))).over(before)
        gap_after = F.min(F.when(has, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(F.least(gap_before, gap_after) <= scope, F.lit(False))

    marked = parts.select("rid", "k", "start", "end", near("identifier").alias("identifier"), near("secret").alias("secret"))
    roles = [kind.role for kind in KINDS]
    base = F.col("k").isin([k for k, kind in enumerate(KINDS) if kind.base])
    weak = (
        F.when(F.col("k").isin([k for k, r in enumerate(roles) if r == "identifier"]), F.col("secret"))
        .when(F.col("k").isin([k for k, r in enumerate(roles) if r == "secret"]), F.col("identifier"))
        .otherwise(F.col("secret") & F.col("identifier"))
    )
    return marked.where(base | weak).select("rid", "k", "start", "end", base.alias("base"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: id and spans, an array of (start, k, end, kind, base) in order of start, then kind.

    Positions are code points, the end is exclusive.
    """
    patterns = {}
    for kind in KINDS:
        patterns.setdefault(PATTERNS.get(kind.name, kind.pattern), kind.group)
    lengths = [_lengths(F.col("text"), p, g).alias(f"m{n}") for n, (p, g) in enumerate(patterns.items())]
    rows = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "id", *lengths)
    stored = materialize(rows, "credential-parts")
    kept = _linked(_placed(stored), scope)
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    span = F.struct("start", "k", "end", names[F.col("k")].alias("kind"), "base")
    spans = kept.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    found = stored.select("rid", "id").join(spans, "rid", "left")
    empty = F.expr("cast(array() as array<struct<start:bigint,k:int,end:bigint,kind:string,base:boolean>>)")
    return found.select("id", F.coalesce("spans", empty).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def summary(scanned: DataFrame) -> DataFrame:
    """id, counts of the base kinds, digest of the base spans, all spans, and the number of linked ones."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])

    def count(name: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")

    counts = [count(name) for name in ("assign", "access", "hex")]
    return scanned.select(
        "id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(spans).alias("spans"),
        (F.size(spans) - F.size(base)).cast("bigint").alias("n_linked"),
    )


def oracle_sql() -> str:
    """The same result in DuckDB SQL over `documents`."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    scans = []
    for k, kind in enumerate(KINDS):
        pattern = quoted(kind.pattern)
        scans.append(f"""
            select rid, {k} as k, '{kind.name}' as kind, g, m, {kind.group} as grp, {kind.least} as least,
                   {kind.most or 1 << 40} as most, {pattern} as pattern, {str(kind.base).lower()} as base, '{kind.role}' as role
            from (select rid, regexp_extract_all(text, {pattern}) as m, string_split_regex(text, {pattern}) as g from d)
            where len(m) > 0""")
    patterns = "".join(
        f" when {k} then length(regexp_extract(match, {quoted(kind.pattern)}, {kind.group}))" for k, kind in enumerate(KINDS)
    )
    return f"""
    with d as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
    scans as ({' union all '.join(scans)}),
    each as (select rid, k, kind, least, most, base, role, unnest(range(1, len(m) + 1)) as i, unnest(m) as match, unnest(g[1:len(m)]) as gap from scans),
    ends as (select *, sum(length(gap) + length(match)) over (partition by rid, k order by i) as end_,
                    case k{patterns} end as value from each),
    parts as (select rid, k, kind, base, role, cast(end_ - length(match) as bigint) as start_, cast(end_ as bigint) as end_
              from ends where value between least and most),
    near as (select *,
        coalesce(least(start_ - max(case when role = 'identifier' then end_ end) over b,
                       min(case when role = 'identifier' then start_ end) over a - end_) <= {SCOPE}, false) as identifier,
        coalesce(least(start_ - max(case when role = 'secret' then end_ end) over b,
                       min(case when role = 'secret' then start_ end) over a - end_) <= {SCOPE}, false) as secret
        from parts
        window b as (partition by rid order by start_, k, end_ rows between unbounded preceding and 1 preceding),
               a as (partition by rid order by start_, k, end_ rows between 1 following and unbounded following)),
    kept as (select rid, kind, k, base, start_, end_, kind || ':' || start_ || ':' || end_ as span from near
             where base or case role when 'identifier' then secret when 'secret' then identifier else secret and identifier end),
    sums as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
                    count(*) filter (kind = 'hex') as n_hex, string_agg(span, ',' order by start_, k) filter (base) as b,
                    string_agg(span, ',' order by start_, k) as s, count(*) filter (not base) as n_linked from kept group by rid)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
           sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans, coalesce(n_linked, 0) as n_linked
    from d left join sums using (rid)"""
