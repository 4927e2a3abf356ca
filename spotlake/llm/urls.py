"""URL filter by a path-template tree (SQL only).

Rules judge the URLs they fit; those verdicts are the labels the tree learns from.  A path's first DEPTH segments are levels of its host's
tree, and all that follows them is one more level, so the tree reads whole paths; numbers in segments become `<n>`.  Branches of a node are
compared with each other: in the order of their smoothed purity, neighbours that differ by less than chance explains merge, and a
branch that stands for several becomes a wildcard, `*` and its place in that order.  A template's purity is its share of blocked labels,
smoothed towards the same template on all hosts, and that towards all labels; URLs without a rule are blocked if it is over one half.

Every step after the first works on counts by distinct template, not on pages, and branches are ordered by the distinct counts of their
labels, not one by one.  Each step is one SQL statement that Spark and DuckDB both run; Spark writes the steps that are read more than once to the shared folder.

Defined cases: a null URL, or one without `://`, has an empty host and path and is judged by that template; of rules of equal length the first
counts; empty segments are segments; a URL counts whole, however long; without labels nothing is blocked; repeated pages all come out; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .shared import cut, table

#: (verdict, host, path): a rule fits its host and subdomains if the path starts with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEPTH = 5
#: Labels that the wider purity weighs as much as.
PRIOR = "2e0"
#: Squared deviations that pass as alike.
ALIKE = "4e0"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quote(s: str) -> str:
    if "'" in s or "\\" in s:
        raise ValueError(f"quotes and backslashes have no place in a rule: {s}")
    return f"'{s}'"


def _case(rules: Sequence[tuple[str, str, str]], value) -> str:
    """The longest rule that fits."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = {_quote(h)} or right(host, {len(h) + 1}) = {_quote('.' + h)}) and left(path, {len(p)}) = {_quote(p)}"
    return "case " + " ".join(f"when {fits(h, p)} then {_quote(value(v, h, p))}" for v, h, p in order) + " end" if order else "cast(null as varchar(1))"


def steps(rules: Sequence[tuple[str, str, str]] = RULES) -> list[tuple[str, str, bool]]:
    """(name, SQL, whether it is read more than once); {x} is an earlier step and {all} replaces every match."""
    g = [f"g{i}" for i in range(1, DEPTH + 2)]
    t = [f"t{i}" for i in range(1, DEPTH + 2)]
    cols = ", ".join
    segments = [f"regexp_replace(split_part(path, '/', {i + 1}), '[0-9]+', '<n>'{{all}})" for i in range(1, DEPTH + 1)]
    # what follows segment DEPTH, whole; a path is empty or begins with a slash
    rest = f"regexp_replace(regexp_replace(path, '^(/[^/]*){{{{0,{DEPTH}}}}}', ''), '[0-9]+', '<n>'{{all}})"
    number = lambda c: f"cast({c} as double)"
    out = [
        ("parsed", f"select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from {{pages}}", False),
        ("judged", f"select page_id, host, path, {_case(rules, lambda v, h, p: h + p)} as rule, {_case(rules, lambda v, h, p: v)} as ruled, {cols(f'{s} as {x}' for s, x in zip([*segments, rest], g))} from {{parsed}}", False),
        ("level0", f"select host, {cols(g)}, sum(case when ruled is not null then 1 else 0 end) as lab, sum(case when ruled = 'block' then 1 else 0 end) as blk from {{judged}} group by host, {cols(g)}", True),
    ]
    for d in range(1, DEPTH + 2):
        done, this, last = t[: d - 1], g[d - 1], f"level{d - 1}"
        above = cols(["host", *done])
        same = lambda a, b, more=(), done=done: " and ".join(f"{a}.{x} = {b}.{x}" for x in ["host", *done, *more])
        out += [
            (f"child{d}", f"select {above}, {this}, sum(lab) as lab, sum(blk) as blk from {{{last}}} group by {above}, {this}", True),
            (f"parent{d}", f"select {above}, ({number('sum(blk)')} + 1e0) / ({number('sum(lab)')} + 2e0) as p from {{child{d}}} group by {above}", False),
            (f"kind{d}", f"select {above}, lab, blk, count(*) as k from {{child{d}}} group by {above}, lab, blk", False),
            (
                f"purer{d}",
                f"select {cols(f'k.{x}' for x in ['host', *done])}, k.lab, k.blk, k.k, p.p as pp, ({number('k.blk')} + {PRIOR} * p.p) / ({number('k.lab')} + {PRIOR}) as q from {{kind{d}}} k join {{parent{d}}} p on {same('k', 'p')}",
                False,
            ),
            (
                f"next{d}",
                f"select *, lag(q) over (partition by {above} order by q, lab, blk) as before, lag(lab) over (partition by {above} order by q, lab, blk) as labs from {{purer{d}}}",
                False,
            ),
            (
                f"island{d}",
                f"select *, sum(case when (q - before) * (q - before) > {ALIKE} * pp * (1e0 - pp) * (1e0 / ({number('lab')} + {PRIOR}) + 1e0 / ({number('labs')} + {PRIOR})) then 1 else 0 end) over (partition by {above} order by q, lab, blk rows unbounded preceding) as island from {{next{d}}}",
                True,
            ),
            (f"wide{d}", f"select {above}, island, sum(k) as k from {{island{d}}} group by {above}, island", False),
            (
                f"named{d}",
                f"select {cols(f'c.{x}' for x in ['host', *done, this])}, case when w.k > 1 then concat('*', cast(w.island as varchar(20))) else c.{this} end as t{d} from {{child{d}}} c join {{island{d}}} i on {same('c', 'i', ('lab', 'blk'))} join {{wide{d}}} w on {same('i', 'w', ('island',))}",
                False,
            ),
            (f"level{d}", f"select l.*, m.t{d} from {{{last}}} l join {{named{d}}} m on {same('l', 'm', (this,))}", True),
        ]
    out += [
        ("everything", f"select ({number('sum(blk)')} + 1e0) / ({number('sum(lab)')} + 2e0) as p0 from {{level{DEPTH + 1}}}", False),
        ("anyhost", f"select {cols(t)}, sum(lab) as lab, sum(blk) as blk from {{level{DEPTH + 1}}} group by {cols(t)}", False),
        ("template", f"select host, {cols(t)}, sum(lab) as lab, sum(blk) as blk from {{level{DEPTH + 1}}} group by host, {cols(t)}", False),
        ("purity", f"select h.host, {cols(f'h.{x}' for x in t)}, ({number('h.blk')} + {PRIOR} * (({number('a.blk')} + {PRIOR} * (select p0 from {{everything}})) / ({number('a.lab')} + {PRIOR}))) / ({number('h.lab')} + {PRIOR}) as p from {{template}} h join {{anyhost}} a on " + " and ".join(f"h.{x} = a.{x}" for x in t), True),
        ("verdicts", f"select l.host, {cols(f'l.{x}' for x in g)}, concat_ws('/', {cols(f'l.{x}' for x in t)}) as template, case when q.p > 5e-1 then 'block' else 'allow' end as learnt from {{level{DEPTH + 1}}} l join {{purity}} q on l.host = q.host and " + " and ".join(f"l.{x} = q.{x}" for x in t), False),
        ("result", "select j.page_id, j.host, j.path, j.rule, coalesce(j.ruled, v.learnt) as verdict, v.template from {judged} j join {verdicts} v on j.host = v.host and " + " and ".join(f"j.{x} = v.{x}" for x in g), False),
    ]
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, template."""
    spark = pages.sparkSession
    known = {"pages": pages}
    for name, sql, often in steps(rules):
        frame = spark.sql(sql.replace("{all}", ""), **known)
        known[name] = cut(frame) if often else frame
    return known["result"]


def duckdb_sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    parts = [(name, sql.replace("{all}", ", 'g'")) for name, sql, _ in steps(rules)]
    names = {"pages": "pages"} | {name: name for name, _ in parts}
    return "with " + ", ".join(f"{name} as ({sql.format(**names)})" for name, sql in parts[:-1]) + " " + parts[-1][1].format(**names)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the URL of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
