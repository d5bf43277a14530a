"""Queries over the fixture tables, one or more for each operator, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import payee as P
from ..functions import text as T
from .. import engine as E
from ..operators import documents as D
from ..operators import footnotes as N
from ..operators import jobs as J
from ..operators import layout as L
from ..operators import pages as G
from ..operators import series as S
from ..operators import statements as B
from ..operators import toc as C
from ..operators import transactions as X
from ..sources import files as I
from ..sources import html as H
from . import fixtures as fx
from .fixtures import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# SQL of the derived payee, for the descriptions that the fixtures hold.
_TITLE = "list_aggregate(list_transform(regexp_extract_all({0}, '([A-Za-z]+|[^A-Za-z]+)'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '')"
_CLEAN = r"regexp_replace(regexp_replace({0}, '\s+SINGAPORE\s+\S*$', ''), '\s+\d{{3,}}$', '')"
_PAYEE = f"""case
  when c like 'BUS/MRT%' then 'TransitLink' when c like 'GRAB%' then 'Grab'
  when c like 'TS/%' then {_TITLE.format("split_part(split_part(c[4:], ' - ', 1), ' COMP', 1)")}
  when c like 'SP %' then {_TITLE.format("trim(c[4:])")}
  when c like 'PAYPAL *%' then {_TITLE.format(r"regexp_replace(regexp_replace(c, '^PAYPAL\s*\*\s*', ''), '\s+\d{10,}.*$', '')")}
  when c like 'AMZN%' then 'Amazon' when upper(c) like '%STARBUCKS%' then 'Starbucks'
  when c like 'GOOGLE %' then 'Google ' || {_TITLE.format("trim(c[8:])")}
  else {_TITLE.format(r"trim(regexp_replace(regexp_replace(split_part(c, ' - ', 1), '\s*@\s*.*$', ''), '\s+\(.*$', ''))")} end"""
_VENDORS = f"""
with {fx.TRANSACTIONS},
cats(payee, category, dict_ord) as (values {fx.CATEGORY_VALUES}), als(alias, payee) as (values {fx.ALIAS_VALUES}),
cleaned as (select *, trim({_CLEAN.format("trim(payee)")}) as c from txns),
derived as (select * exclude (c), {_PAYEE} as raw from cleaned),
named as (select d.*, coalesce(a.payee, raw) as vendor from derived d left join als a on lower(raw) = a.alias)"""
# The usual table of the longest common subsequence, folded row by row.
_LCS = """list_reduce(list_prepend([x * 0 for x in range(length(b) + 1)], list_transform(range(1, length(a) + 1), lambda i: [i])),
  lambda prev, i: list_reduce(list_prepend([0], list_transform(range(1, length(b) + 1), lambda j: [j])),
    lambda acc, j: list_append(acc, case when a[i[1]] = b[j[1]] then prev[j[1]] + 1 else greatest(prev[j[1] + 1], acc[-1]) end)))[-1]"""
_CATEGORISED = (
    _VENDORS
    + f""",
v as (select distinct vendor from named),
pairs as (select vendor, lower(vendor) as a, lower(payee) as b, category, dict_ord from v, cats),
scored as (select *, {_LCS} as lcs from pairs where not exists (select 1 from cats c where lower(c.payee) = lower(vendor)) and 3 * least(length(a), length(b)) >= 2 * greatest(length(a), length(b))),
fuzzy as (select vendor, arg_max(category, (200 * lcs / (length(a) + length(b)), -dict_ord)) as category from scored where 200 * lcs >= 80 * (length(a) + length(b)) group by vendor),
exact as (select vendor, category from v join cats on payee = vendor),
folded as (select vendor, arg_min(category, dict_ord) as category from v join cats on lower(payee) = lower(vendor) group by vendor),
found as (
  select vendor, coalesce(e.category, f.category, z.category, 'Other') as category,
    case when e.category is not null then 'exact' when f.category is not null then 'case' when z.category is not null then 'fuzzy' else 'other' end as how
  from v left join exact e using (vendor) left join folded f using (vendor) left join fuzzy z using (vendor))"""
)
_DEDUPED = "firsts as (select * from (select *, row_number() over (partition by date, payee, memo, round_even(amount * 100, 0), credit order by file_ord, row_ord) as rn from named) where rn = 1)"


@query(
    _CATEGORISED
    + f""", {_DEDUPED}
select date as "Date", payee as "Description", f.vendor as "Payee", category as "Category", memo as "Memo", source_file as "SourceFile",
  printf('%.2f', case when credit then amount else -amount end) as "Amount"
from firsts f join found using (vendor)"""
)
def convert_bulk(s: SparkSession, d: str) -> DataFrame:
    return B.convert_bulk(fx.transactions(s, d), fx.aliases(s), fx.categories(s))


@query(
    _CATEGORISED
    + f""", {_DEDUPED}
select date as "Date", payee as "Description", f.vendor as "Payee", category as "Category", memo as "Memo",
  case when credit then '' else printf('%.2f', amount) end as "Outflow", case when credit then printf('%.2f', amount) else '' end as "Inflow"
from firsts f join found using (vendor)"""
)
def txn_csv_columns(s: SparkSession, d: str) -> DataFrame:
    return X.csv_columns(X.categorised(X.dedupe(fx.transactions(s, d)), fx.aliases(s), fx.categories(s)), single_amount=False)


@query(_CATEGORISED + " select vendor, category, how from found")
def category_lookup(s: SparkSession, d: str) -> DataFrame:
    return X.categories(X.with_canonical(fx.transactions(s, d), fx.aliases(s)), fx.categories(s))


@query(_VENDORS + " select payee, raw, vendor, count(*) as n from named group by all")
def derive_payee(s: SparkSession, d: str) -> DataFrame:
    txns = X.with_canonical(fx.transactions(s, d), fx.aliases(s))
    return txns.groupBy("payee", P.derive_payee(F.col("payee")).alias("raw"), "vendor").agg(F.count("*").alias("n"))


@query(
    f"with {fx.TRANSACTIONS}, named as (select * from txns), {_DEDUPED} select date, payee, memo, amount, credit, file_ord, row_ord, source_file from firsts"
)
def txn_dedupe_first(s: SparkSession, d: str) -> DataFrame:
    return X.dedupe(fx.transactions(s, d))


@query(
    f"with {fx.TRANSACTIONS} select date, payee, amount, row_number() over (order by date, payee, memo, amount, credit, file_ord, row_ord) as place from txns order by place limit 100"
)
def txn_sort_first_100(s: SparkSession, d: str) -> DataFrame:
    top = X.ordered(fx.transactions(s, d)).limit(100)
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy(*X.ORDER)).cast("long")  # over 100 rows
    return top.select("date", "payee", "amount", place.alias("place"))


@query(f"with {fx.TRANSACTIONS} select source_file, count(*) as n_transactions from txns group by 1")
def txn_file_stats(s: SparkSession, d: str) -> DataFrame:
    return X.file_stats(fx.transactions(s, d))


_AMOUNT_FORMS = "case o_orderkey % 6 when 0 then p when 1 then '(' || p || ')' when 2 then '-' || p when 3 then '$ ' || p when 4 then ' ' else replace(p, ',', '') end"


@query(
    f"""
with t as (select o_orderkey, format('{{:,.2f}}', o_totalprice) as p from orders), u as (select o_orderkey, trim({_AMOUNT_FORMS}) as t from t),
v as (select *, regexp_extract(t, '[0-9]{{1,3}}(?:,[0-9]{{3}})*\\.\\d{{2}}') as m from u)
select o_orderkey, t as raw, case when m = '' then null when t like '(%)' or t like '-%' then -replace(m, ',', '')::double else replace(m, ',', '')::double end as amount from v"""
)
def parse_amount(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    p = F.format_number("o_totalprice", 2)
    k = F.pmod("o_orderkey", F.lit(6))
    raw = F.trim(F.when(k == 0, p).when(k == 1, F.concat(F.lit("("), p, F.lit(")"))).when(k == 2, F.concat(F.lit("-"), p)).when(k == 3, F.concat(F.lit("$ "), p)).when(k == 4, " ").otherwise(F.replace(p, F.lit(","), F.lit(""))))
    return o.select("o_orderkey", raw.alias("raw"), M.parse_amount(raw).alias("amount"))


@query(
    """
with t as (select o_orderkey, o_orderdate as x, strftime(o_orderdate, '%Y-%m-%d') as iso from orders)
select o_orderkey, case o_orderkey % 6
  when 0 then '2025-' || iso[6:] when 1 then iso when 2 then '20' || iso[3:] when 3 then iso
  when 4 then '2025-' || iso[6:] else null end as date from t"""
)
def parse_date(s: SparkSession, d: str) -> DataFrame:
    x, k = F.col("o_orderdate"), F.pmod("o_orderkey", F.lit(6))
    f = lambda p: F.date_format(x, p)
    short = F.concat(f("d/M/"), F.concat(F.lit("20"), F.substring(f("yyyy"), 3, 2)))
    raw = F.when(k == 0, f("d MMM yyyy")).when(k == 1, f("d/M/yyyy")).when(k == 2, short).when(k == 3, f("yyyy-MM-dd")).when(k == 4, f("MMM dd")).otherwise(F.concat(F.lit("on "), f("d/M/yyyy")))
    return table(s, d, "orders").select("o_orderkey", M.parse_date(raw, F.lit(2025)).alias("date"))


@query(
    """
with t as (select o_orderkey, month(o_orderdate) as m, case o_orderkey % 3 when 0 then 3 when 1 then 12 else 1 end as sm, case o_orderkey % 3 when 2 then null else year(o_orderdate) end as sy from orders)
select o_orderkey, sy as statement_year, sm as statement_month, case when m > sm then sy - 1 else sy end as year from t"""
)
def infer_year(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    k, y = F.pmod("o_orderkey", F.lit(3)), F.date_format("o_orderdate", "yyyy")
    text = F.when(k == 0, F.concat(F.lit("As at 31 Mar "), y)).when(k == 1, F.concat(F.lit("dated 5 Dec "), y, F.lit("."))).otherwise("none")
    sy, sm = M.statement_year(text), M.statement_month(text)
    out = o.select("o_orderkey", sy.cast("long").alias("statement_year"), sm.alias("statement_month"), F.month("o_orderdate").alias("m"))
    return out.select("o_orderkey", "statement_year", "statement_month", M.infer_year(F.col("m"), F.col("statement_year"), F.col("statement_month")).alias("year"))


_HEADERS = [
    ["Date", "Description", "Withdrawal", "Deposit", "Balance"],
    ["Date", "Details", "Withdrawal", "Deposit"],
    ["Transaction Date", "Amount"],
    ["Date", "Memo", "Amount"],
    ["Description"],
]
_ROLES = [(0, 1, 2, 1, None, 4), (0, 1, 2, 3, None, None), (0, 0, None, None, 1, None), (0, None, None, None, 2, None), (None, 0, None, 0, None, None)]
_ROLE_SQL = ", ".join("(" + ", ".join("null" if x is None else str(x) for x in (k, *r)) + ")" for k, r in enumerate(_ROLES))


@query(
    f"""
with r(k, date_at, desc_at, withdrawal_at, deposit_at, amount_at, balance_at) as (values {_ROLE_SQL})
select o_orderkey, date_at, desc_at, withdrawal_at, deposit_at, amount_at, balance_at, k in (0, 1, 2, 3) as financial
from orders join r on o_orderkey % 5 = k"""
)
def financial_columns(s: SparkSession, d: str) -> DataFrame:
    h = F.get(F.array(*[F.array(*map(F.lit, x)) for x in _HEADERS]), F.pmod("o_orderkey", F.lit(5)).cast("int"))
    o = table(s, d, "orders").select("o_orderkey", h.alias("h"))
    return o.select("o_orderkey", *[M.find_column(F.col("h"), r).alias(f"{r}_at") for r in M.COLUMN_PATTERNS], M.is_financial(F.col("h")).alias("financial"))


_LAYOUTS = [["Date", "Details", "Withdrawal", "Deposit"], ["Date", "Memo", "Amount"], ["Date", "Details", "Debit"], ["Date", "Details", "Inflow"]]


@query(
    """
with t as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, o_orderpriority as p, o_orderkey % 4 as k, round_even(o_totalprice, 2) as a, o_orderstatus = 'F' as f from orders)
select o_orderkey, iso as date, case k when 1 then '' else p end as payee, '' as memo, a as amount, case k when 2 then false when 3 then true else f end as credit from t"""
)
def financial_rows(s: SparkSession, d: str) -> DataFrame:
    a, f, none = F.format_number(F.bround("o_totalprice", 2), 2), F.col("o_orderstatus") == "F", F.lit("")
    dt, p, k = F.date_format("o_orderdate", "dd/MM/yyyy"), F.col("o_orderpriority"), F.pmod("o_orderkey", F.lit(4)).cast("int")
    cells = F.array(
        F.array(dt, p, F.when(f, none).otherwise(a), F.when(f, a).otherwise(none)),
        F.array(dt, none, F.when(f, a).otherwise(F.concat(F.lit("-"), a))),
        F.array(dt, p, a),
        F.array(dt, p, a),
    )
    heads = F.array(*[F.array(*map(F.lit, x)) for x in _LAYOUTS])
    rows = F.array(F.get(cells, k), F.array(F.lit("Total"), F.lit("x")))
    return X.parse_tables(table(s, d, "orders").select("o_orderkey", F.get(heads, k).alias("headers"), rows.alias("rows")), F.lit(2025)).drop("row_ord")


@query(f"select p_partkey, {_TITLE.format('upper(p_name) || chr(39) || lower(p_brand)')} as title from part")
def title_case(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", T.title_case(F.concat(F.upper("p_name"), F.lit("'"), F.lower("p_brand"))).alias("title"))


@query("select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, e' \\t\\r\\n\\x0B\\f')), lambda x: x <> ''), chr(10)) as cleaned from documents")
def clean_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.clean_lines(F.col("text")).alias("cleaned"))


_LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_ord from documents)"
_NORM = r"lower(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '\b\d{{1,4}}\b', '#', 'g'))"


@query(f"with {_LINES} select {_NORM.format('line')} as norm, count(*) as n from lines where doc_id % 2 = 0 or true group by 1 having count(*) > 1")
def normalise_line(s: SparkSession, d: str) -> DataFrame:
    lines = D.lines_of(table(s, d, "documents"), ["doc_id"])
    return lines.groupBy(T.normalise_line(F.col("line")).alias("norm")).agg(F.count("*").alias("n")).where("n > 1")


@query(r"select conv_id, turn, regexp_replace(text || ' ' || chr(160) || chr(9) || 'x' || chr(8203) || 'y', '[ \t\r\x0B\f" + " " + r"]+', ' ', 'g') as t0, replace(t0, chr(8203), '') as normal from conversations")
def normalise_text(s: SparkSession, d: str) -> DataFrame:
    t = F.concat("text", F.lit("  \tx​y"))
    flat = F.regexp_replace(t, "[ \\t\\r\\x0B\\f ]+", " ")
    return table(s, d, "conversations").select("conv_id", "turn", flat.alias("t0"), T.normalise_text(t).alias("normal"))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(text || '  ' || chr(10) || chr(10) || chr(10) || 'end', '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), e' \t\r\n\x0B\f') || chr(10) as md from documents")
def md_cleanup(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.cleanup_markdown(F.concat("text", F.lit("  \n\n\nend"))).alias("md"))


_MD_STEPS = [("\\n{3,}", "\n\n"), ("[^\\S\\n]+(\\n|$)", "\\1"), ("([^\\n])\\n(#{1,6}\\s)", "\\1\n\n\\2"), ("(#{1,6}\\s[^\\n]+)\\n([^\\n#])", "\\1\n\n\\2"), ("(\\|[^\\n]*)\\n\\n(\\|)", "\\1\n\\2"),
             ("(\\|[^\\n]*)\\n\\n(\\|)", "\\1\n\\2"), ("([^\\n|])\\n(\\|)", "\\1\n\n\\2"), ("(\\|[^\\n]*)\\n([^\\n|])", "\\1\n\n\\2"), ("\\n{3,}", "\n\n")]
_MD = "raw"
for _pattern, _to in _MD_STEPS:
    _MD = f"regexp_replace({_MD}, '{_pattern}', '{_to}', 'g')"


@query(
    f"""
with l as (select conv_id, turn, role, text, case turn % 3 when 0 then '# ' || role || chr(10) || text when 1 then '| ' || role || ' | ' || turn || ' |' || chr(10) || chr(10) || '| --- | --- |  ' else text || '   ' end as t from conversations),
r as (select conv_id, count(*) as n, string_agg(t, chr(10) order by turn, role, text) as raw from l group by conv_id)
select conv_id, n, trim({_MD}, e' \\t\\r\\n\\x0B\\f') as md from r"""
)
def md_postprocess(s: SparkSession, d: str) -> DataFrame:
    turn, role, text = F.col("turn"), F.col("role"), F.col("text")
    k = F.pmod(turn, F.lit(3))
    t = F.when(k == 0, F.concat(F.lit("# "), role, F.lit("\n"), text)).when(k == 1, F.concat(F.lit("| "), role, F.lit(" | "), turn.cast("string"), F.lit(" |\n\n| --- | --- |  "))).otherwise(F.concat(text, F.lit("   ")))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, role, text, t.alias("t")))), lambda x: x["t"]), "\n")
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), T.postprocess_markdown(raw).alias("md"))


_PAGE_LINES = f"""
pl as (select source as doc, doc_id as page, list_filter(string_split(text, chr(10)), lambda x: trim(x, e' \\t\\r\\n\\x0B\\f') <> '') as f from documents),
bands as (select doc, page, 'top' as band, unnest(f[1:3]) as line from pl union all select doc, page, 'bottom', unnest(f[greatest(len(f) - 2, 1):]) from pl),
np as (select doc, count(distinct page) as n_pages from pl group by 1 having count(distinct page) >= 5),
seen as (select distinct doc, page, band, {_NORM.format('line')} as norm from bands),
prints as (select doc, norm, count(*) as n from seen join np using (doc) where length(norm) >= 2 group by doc, norm, n_pages having count(*) >= greatest(2, floor(n_pages * 0.05)))"""


@query(f"with {_PAGE_LINES} select doc, norm, n from prints")
def header_footer_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return D.repeated_lines(fx.pages(s, d), ratio=0.05)


@query(
    f"""with {_PAGE_LINES}, lines as (select source as doc, doc_id as page, unnest(string_split(text, chr(10))) as line from documents)
select doc, count(*) as n_lines, sum(length(line))::bigint as n_chars from lines where not regexp_matches(line, '^\\s*\\d{{1,4}}\\s*$')
  and not exists (select 1 from prints p where p.doc = lines.doc and p.norm = {_NORM.format('line')}) group by doc"""
)
def strip_header_footer(s: SparkSession, d: str) -> DataFrame:
    pages = fx.pages(s, d)
    kept = D.strip_repeated(D.lines_of(pages, ["doc", "page"]), D.repeated_lines(pages, ratio=0.05))
    return kept.groupBy("doc").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("with l as (select p_partkey, case p_partkey % 4 when 0 then p_name || ' ... ' || p_size when 1 then '| ' || p_name || ' | ' || p_size || 'A |' when 2 then p_name || ' iv.' else '|---|---|' end as line, p_partkey % 4 as k from part) select p_partkey, line, k in (0, 1, 2) as is_toc from l")
def toc_rows(s: SparkSession, d: str) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(4))
    size = F.col("p_size").cast("string")
    line = F.when(k == 0, F.concat("p_name", F.lit(" ... "), size)).when(k == 1, F.concat(F.lit("| "), "p_name", F.lit(" | "), size, F.lit("A |"))).when(k == 2, F.concat("p_name", F.lit(" iv."))).otherwise("|---|---|")
    return table(s, d, "part").select("p_partkey", line.alias("line"), T.is_toc_row(line).alias("is_toc"))


def _toc_lines(s: SparkSession, d: str) -> DataFrame:
    """Parts as lines of documents: every seventh is a heading, the brand decides about page numbers."""
    p = table(s, d, "part")
    k = F.col("p_partkey")
    line = F.when(F.pmod(k, F.lit(7)) == 0, F.concat(F.lit("# "), "p_brand")).when(F.pmod(F.floor(k / 7), F.lit(3)) == 0, F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.concat("p_name", F.lit(" plain words")))
    return p.select(F.floor(k / 50).cast("string").alias("doc"), k.alias("line_ord"), line.alias("line"))


_TOC_LINES = "tl as (select (p_partkey // 50)::varchar as doc, p_partkey as line_ord, case when p_partkey % 7 = 0 then '# ' || p_brand when (p_partkey // 7) % 3 = 0 then p_name || ' ' || p_size else p_name || ' plain words' end as line from part)"


@query(
    f"""with {_TOC_LINES},
s as (select *, sum((line like '# %')::int) over (partition by doc order by line_ord) as section from tl)
select doc, section::bigint as section, min(case when line like '# %' then lower(line[3:]) end) as title, count_if(line not like '# %') as n_rows,
  count_if(line not like '# %' and line not like '% plain words') as n_toc, false as long_row,
  count_if(line not like '# %') >= 5 and 10 * count_if(line not like '# %' and line not like '% plain words') >= 6 * count_if(line not like '# %') as is_toc
from s group by doc, section"""
)
def toc_sections(s: SparkSession, d: str) -> DataFrame:
    return D.toc_sections(_toc_lines(s, d))


@query(
    f"""with {_TOC_LINES},
s as (select *, sum((line like '# %')::int) over (partition by doc order by line_ord) as section from tl),
t as (select doc, section, count_if(line not like '# %' and line not like '% plain words') as n_toc from s group by 1, 2),
k as (select s.* from s join t using (doc, section) where n_toc < 5)
select doc, coalesce(string_agg(k.line, chr(10) order by k.line_ord), '') as text, (select sum(case when x.section > 0 then 1 else x.n_toc end) from t x where x.doc = a.doc and x.n_toc >= 5)::bigint as n_dropped
from (select distinct doc from tl) a left join k using (doc) group by doc"""
)
def toc_strip(s: SparkSession, d: str) -> DataFrame:
    lines = _toc_lines(s, d).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return C.strip_toc(lines).withColumn("n_dropped", F.nullif("n_dropped", F.lit(0).cast("long")))


@query(
    """
with l as (select (p_partkey // 50)::varchar as doc, p_partkey as k, case when p_partkey % 9 < 6 then 'T' when p_partkey % 9 < 8 then 'S' else 'O' end as kind from part),
g as (select *, sum((kind = 'O')::int) over (partition by doc order by k) as run from l),
n as (select *, count_if(kind = 'T') over (partition by doc, run) as n_toc from g)
select doc, count_if(not (kind <> 'O' and n_toc >= 5)) as n_lines, count_if(kind = 'T' and n_toc >= 5) as n_dropped from n group by doc"""
)
def inline_toc_runs(s: SparkSession, d: str) -> DataFrame:
    p, k = table(s, d, "part"), F.pmod("p_partkey", F.lit(9))
    line = F.when(k < 6, F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))).when(k == 6, "|---|---|").when(k == 7, "").otherwise(F.concat("p_name", F.lit(" plain words.")))
    docs = p.groupBy(F.floor(F.col("p_partkey") / 50).cast("string").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    out = C.strip_toc(docs.withColumn("text", F.concat("text", F.lit("\n."))))
    return out.select("doc", (F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"), "n_dropped")


@query("select c_nationkey, arg_max(v, (n, -f)) as v, max(n) as n from (select c_nationkey, round_even(c_acctbal / 500, 0) as v, count(*) as n, min(c_custkey) as f from customer group by 1, 2) group by 1")
def font_mode(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_nationkey", "c_custkey", F.bround(F.col("c_acctbal") / 500).alias("v"))
    return S.mode_first(c, ["c_nationkey"], "v", "c_custkey")


_CLUSTERS = """
g as (select p_brand, p_retailprice as v, lag(p_retailprice) over (partition by p_brand order by p_retailprice desc) - p_retailprice as gap from part),
c as (select p_brand, v, sum(case when gap <= 0.5 then 0 else 1 end) over (partition by p_brand order by v desc) as cluster from g),
k as (select p_brand, cluster::bigint as cluster, avg(v) as mean, count(*) as n from c group by 1, 2)"""


@query(f"with {_CLUSTERS} select p_brand, cluster, round(mean, 4) as mean, n from k")
def font_clusters(s: SparkSession, d: str) -> DataFrame:
    return S.single_link(table(s, d, "part"), ["p_brand"], "p_retailprice", 0.5).withColumn("mean", F.round("mean", 4))


@query(
    f"""with {_CLUSTERS}, b as (select *, arg_max(mean, (n, mean)) over (partition by p_brand) as body from k),
h as (select p_brand, n, round(mean, 4) as mean, row_number() over (partition by p_brand order by mean desc) as level from b where mean >= 1.05 * body)
select p_brand, mean, n, level from h where level <= 4"""
)
def heading_levels(s: SparkSession, d: str) -> DataFrame:
    k = S.single_link(table(s, d, "part"), ["p_brand"], "p_retailprice", 0.5)
    return S.heading_levels(k, ["p_brand"], ratio=1.05).select("p_brand", F.round("mean", 4).alias("mean"), "n", F.col("level").cast("long").alias("level"))


@query(
    """
with a as (select p_brand, list_sort(list_distinct(list(p_size::double)), 'DESC') as v from part group by 1),
t as (select p_brand, list_reduce(list_prepend([]::double[], list_transform(v, lambda x: [x])), lambda acc, x: case when len(acc) = 0 or acc[-1] - x[1] > 4 then list_append(acc, x[1]) else acc end) as t from a)
select p_brand, array_to_string(t, ',') as tiers from t"""
)
def anchored_tiers(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("double")).alias("v"))
    return p.select("p_brand", F.array_join(S.anchored_tiers(F.col("v"), 4.0), ",").alias("tiers"))


@query(f"with {fx.WORDS} select doc, round_even(top / 3, 0)::bigint as line, string_agg(text, ' ' order by x0, word_ord) as text, count(*) as n_words from words group by doc, round_even(top / 3, 0)")
def line_buckets(s: SparkSession, d: str) -> DataFrame:
    return L.bucket_lines(fx.words(s, d)).drop("page")


@query(f"with {fx.WORDS}, {fx.BOXES} select doc, word_ord, x0, top from words w where not exists (select 1 from boxes b where b.doc = w.doc and b.page = w.page and w.x0 >= bx0 - 5 and w.x1 <= bx1 + 5 and w.top >= by0 - 5 and w.bottom <= by1 + 5)")
def words_outside_tables(s: SparkSession, d: str) -> DataFrame:
    return L.words_outside(fx.words(s, d), fx.boxes(s, d)).select("doc", "word_ord", "x0", "top")


@query("select l_orderkey, l_linenumber, l_quantity, case when len(list_filter([5, 12, 25, 40], lambda e: e <= l_quantity + 2)) between 1 and 3 then (len(list_filter([5, 12, 25, 40], lambda e: e <= l_quantity + 2)) - 1)::int end as bucket from lineitem")
def edge_bucket(s: SparkSession, d: str) -> DataFrame:
    edges = F.array(*[F.lit(float(x)) for x in (5, 12, 25, 40)])
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", L.edge_bucket(F.col("l_quantity"), edges).alias("bucket"))


_CELLS = f"""{fx.WORDS}, wl as (select doc, round_even(top / 9, 0)::int as line, word_ord, x0, x0 + 1 + word_ord % 2 as x1, top as y0, bottom as y1, text from words),
h as (select doc, avg(y1 - y0) as height from wl group by 1),
g as (select wl.*, height, x0 - lag(x1) over (partition by doc, line order by x0, word_ord) as gap from wl join h using (doc)),
m as (select doc, any_value(height) as height, list_sort(list(gap) filter (gap > 0 and gap < 2 * height))[(count(*) filter (gap > 0 and gap < 2 * height)) // 2 + 1] as typical from g group by 1),
c as (select g.*, sum((coalesce(gap > greatest(4 * coalesce(typical, 0.5 * m.height), m.height), false))::int) over (partition by g.doc, line order by x0, word_ord) as cell from g join m using (doc))"""


@query(f"with {_CELLS} select doc, line, cell::bigint as cell, string_agg(text, ' ' order by x0, word_ord) as text from c group by doc, line, cell")
def cell_split(s: SparkSession, d: str) -> DataFrame:
    w = fx.words(s, d)
    line, x1 = F.bround(F.col("top") / 9).cast("int"), F.col("x0") + 1 + F.pmod("word_ord", F.lit(2))
    return L.split_cells(w.select("doc", "page", line.alias("line"), "word_ord", "x0", x1.alias("x1"), F.col("top").alias("y0"), F.col("bottom").alias("y1"), "text")).drop("page").withColumn("cell", F.col("cell").cast("long"))


@query(
    """
with r as (select (o_orderkey // 40)::varchar as doc, o_orderkey as line, (1 + o_custkey % 3)::bigint as n_cells from orders),
m as (select *, coalesce(lag(n_cells) over (partition by doc order by line) <> n_cells, true) as new from r),
g as (select *, sum(new::int) over (partition by doc order by line) as run from m)
select doc, min(line) as first, count(*) as n, min(n_cells) as n_cells, case when count(*) >= 2 then 'table' else 'header' end as kind from g where n_cells > 1 group by doc, run"""
)
def row_runs(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.floor(F.col("o_orderkey") / 40).cast("string").alias("doc"), F.col("o_orderkey").alias("line"), (1 + F.pmod("o_custkey", F.lit(3))).alias("n_cells"))
    return L.row_runs(o)


@query(
    """
with l as (select (o_orderkey // 60)::varchar as doc, (o_orderkey % 2)::int as col, o_orderkey as line_ord, (o_orderkey % 60) * (8 + o_custkey % 5)::double as top, 8.0 as line_gap, o_custkey % 11 = 0 as is_heading, o_orderkey::varchar as text from orders),
s as (select *, top - lag(top) over w as step, coalesce(lag(is_heading) over w, false) as after from l window w as (partition by doc, col order by top, line_ord)),
p as (select *, sum((not coalesce(step <= greatest(1.8 * line_gap, 12), false) or is_heading or after)::int) over (partition by doc, col order by top, line_ord) as para from s)
select doc, col, para::bigint as para, string_agg(text, ' ' order by top, line_ord) as text, count(*) as n_lines, max(top) as last_y from p group by 1, 2, 3"""
)
def paragraph_merge(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select(
        F.floor(k / 60).cast("string").alias("doc"), F.pmod(k, F.lit(2)).cast("int").alias("col"), k.alias("line_ord"), (F.pmod(k, F.lit(60)) * (8 + F.pmod("o_custkey", F.lit(5)))).cast("double").alias("top"),
        F.lit(8.0).alias("line_gap"), (F.pmod("o_custkey", F.lit(11)) == 0).alias("is_heading"), k.cast("string").alias("text"),
    )
    return L.merge_paragraphs(o)


@query(
    """
with w as (select event_type as doc, (user_id % 40)::int as page, round_even(abs(value), 0) * 3 as cx, 600.0 as width from events),
g as (select *, cx - lag(cx) over (partition by doc, page order by cx) as gap from w),
m as (select doc, page, count(*) as n, list_sort(list(gap) filter (gap is not null))[count(gap) // 2 + 1] as typical from g group by 1, 2),
s as (select doc, page, n, case when gap > 0 and cx - gap / 2 between 0.2 * width and 0.8 * width then gap / (case when typical = 0 then 1 else typical end) end as r, cx - gap / 2 as mid from g join m using (doc, page)),
b as (select doc, page, any_value(n) as n, coalesce(max(r / (r + 8)), 0) as score, arg_max(mid, (r, -mid)) filter (r is not null) as mid from s group by 1, 2)
select doc, page, case when n >= 40 and score >= 0.55 then 'two' else 'single' end as layout, round_even(case when n < 40 then 1 when score >= 0.55 then score else 1 - score end, 3) as confidence,
  case when n >= 40 and score >= 0.55 then round(mid, 6) end as split_x from b"""
)
def column_detect(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "events").select(F.col("event_type").alias("doc"), F.pmod("user_id", F.lit(40)).cast("int").alias("page"), (F.bround(F.abs("value")) * 3).alias("cx"), F.lit(600.0).alias("width"))
    return L.detect_columns(w).withColumn("split_x", F.round("split_x", 6))


_SMALL = "list_transform(range(0, 8), lambda k: list_sum(embedding[k * 8 + 1 : k * 8 + 8]::double[]) / 8)"
_HASH = "list_aggregate(list_transform({0}, lambda x: case when x >= list_sum({0}) / len({0}) then '1' else '0' end), 'string_agg', '')"


@query(f"with b as (select vec_id, label, embedding::double[] as e from embeddings) select vec_id, label as page, {_HASH.format('e')} as hash from b")
def phash_bits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("label").alias("page"), L.average_hash(F.col("embedding").cast("array<double>")).alias("hash"))


@query(f"with b as (select label as page, {_SMALL} as e from embeddings), h as (select page, {_HASH.format('e')} as hash from b) select hash, count(distinct page) as n_pages from h group by 1 having count(distinct page) >= 3")
def phash_repeated(s: SparkSession, d: str) -> DataFrame:
    small = L.shrink(F.col("embedding").cast("array<double>"), 8)
    return L.repeated_hashes(table(s, d, "embeddings").select(F.col("label").alias("page"), L.average_hash(small).alias("hash")))


@query("select conv_id, string_agg('=== ' || n || ' ===' || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n, text) as merged, count(*) as n_files from (select conv_id, text, 'turn' || lpad(turn::varchar, 4, '0') || '.txt' as n from conversations) group by 1")
def merge_consolidated(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").withColumn("n", F.concat(F.lit("turn"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".txt")))
    return D.merge_texts(c, ["conv_id"], "n", "text")


@query("select filename, event_id, user_id, f as file_ord from (select event_type || '-' || (user_id % 50) as filename, event_id, user_id, event_id as f, row_number() over (partition by event_type, user_id % 50 order by event_id desc) as rn from events) where rn = 1")
def last_upload_wins(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.concat("event_type", F.lit("-"), F.pmod("user_id", F.lit(50)).cast("string")).alias("filename"), "event_id", "user_id", F.col("event_id").alias("file_ord"))
    return D.last_upload_wins(e)


@query("select r_name, '| Key | Name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, 'A', '\\|') || ' |', chr(10) order by n_nationkey) as md from nation join region on n_regionkey = r_regionkey group by r_name")
def table_markdown(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation"), table(s, d, "region")
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.replace("n_name", F.lit("A"), F.lit("|"))).alias("c"))
    g = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"]).alias("rows"))
    return g.select("r_name", T.table_markdown(F.array(F.lit("Key"), F.lit("Name")), F.col("rows")).alias("md"))


@query("select page_id, '---' || chr(10) || 'title: Page ' || page_id || chr(10) || 'source: \"' || url || '\"' || chr(10) || 'lang: xx' || chr(10) || '---' as front from pages")
def frontmatter(s: SparkSession, d: str) -> DataFrame:
    meta = F.create_map(F.lit("lang"), F.lit("xx"), F.lit("source"), F.col("url"), F.lit("title"), F.concat(F.lit("Page "), F.col("page_id").cast("string")))
    return table(s, d, "pages").select("page_id", T.front_matter(meta).alias("front"))


@query(
    """
with r as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as record from conversations)
select conv_id, record::bigint as record, count(*) as n, string_agg(text, chr(10) order by turn, text) as joined from r where record > 0 group by 1, 2"""
)
def record_fold(s: SparkSession, d: str) -> DataFrame:
    return D.fold_records(table(s, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "text")


@query(f"with {fx.JOBS} select job_id, status, case status when 'running' then 0 when 'queued' then 1 + (select count(*) from jobs q where q.status = 'queued' and q.created_at < jobs.created_at) end as position from jobs")
def job_queue_position(s: SparkSession, d: str) -> DataFrame:
    return J.queue_position(fx.jobs(s, d)).select("job_id", "status", "position")


@query(f"with {fx.JOBS} select job_id, status, created_at from jobs order by created_at desc, job_id limit 20")
def job_recent(s: SparkSession, d: str) -> DataFrame:
    return J.recent(fx.jobs(s, d)).select("job_id", "status", "created_at")


@query(f"with {fx.JOBS} select job_id, 'running' as status, created_at from jobs where status = 'queued' order by created_at, job_id limit 1")
def job_claim(s: SparkSession, d: str) -> DataFrame:
    return J.claim(fx.jobs(s, d)).select("job_id", "status", "created_at")


_RATES = f"rates as (select ocr_expected, list_sort(list(actual_sec / greatest(1, page_count)))[count(*) // 2 + 1] as rate from jobs where finished_at >= timestamp '{fx.NOW}' - interval 30 days group by 1 having count(*) >= 3)"


@query(f"with {fx.JOBS}, {_RATES} select job_id, round(case when page_count = 0 then 4.0 else 4.0 + page_count * coalesce(rate, case when ocr_expected then 45.0 else 12.0 end) end, 6) as estimate_sec from jobs left join rates using (ocr_expected)")
def job_eta(s: SparkSession, d: str) -> DataFrame:
    j = fx.jobs(s, d)
    return J.estimates(j, j, F.lit(fx.NOW).cast("timestamp_ntz")).select("job_id", F.round("estimate_sec", 6).alias("estimate_sec"))


@query(f"with {fx.JOBS} select status, count(*) as n from jobs where not coalesce(finished_at < timestamp '{fx.NOW}' - interval 7 days, false) group by 1")
def job_retention(s: SparkSession, d: str) -> DataFrame:
    return J.retained(fx.jobs(s, d), F.lit(fx.NOW).cast("timestamp_ntz")).groupBy("status").agg(F.count("*").alias("n"))


@query("select user_id as job_id, arg_max(event_type, (ts, event_id)) as status, count(*) as n_events from events group by 1")
def job_state(s: SparkSession, d: str) -> DataFrame:
    return J.latest_state(table(s, d, "events").select("event_id", "ts", F.col("user_id").alias("job_id"), F.col("event_type").alias("status")))


@query("select user_id as job_id, case when count(distinct e) = 1 then min(e) when count(distinct e) > 1 then 'mixed' end as engine from (select user_id, case when value > 50 then event_type end as e from events) group by 1")
def job_engine(s: SparkSession, d: str) -> DataFrame:
    return J.engine_of(table(s, d, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("value") > 50, F.col("event_type")).alias("engine")))


@query("with t as (select user_id as request_id, case user_id % 3 when 0 then 'raw' else 'pdf2md' end as scheme, sum(event_id * 100)::bigint as bytes, sum(event_id % 3)::bigint as pages from events group by 1, 2) select *, case when scheme <> 'raw' and (bytes > 2097152 or pages > 5) then 'queued' else 'inline' end as route from t")
def job_route(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return J.route(e.select(F.col("user_id").alias("request_id"), F.when(F.pmod("user_id", F.lit(3)) == 0, "raw").otherwise("pdf2md").alias("scheme"), (F.col("event_id") * 100).alias("bytes"), F.pmod("event_id", F.lit(3)).alias("pages")))


@query("select d.doc_id as page, d.source as doc, coalesce(sum(quality), 0)::bigint as table_count, coalesce(sum(toxic), 0)::bigint as figure_count from documents d left join labels l using (doc_id) group by 1, 2")
def page_confidence(s: SparkSession, d: str) -> DataFrame:
    pages = fx.pages(s, d).drop("text")
    marked = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "quality", "toxic")
    return D.page_confidence(pages, marked.where("quality > 0"), marked.where("toxic > 0"))


_STRIP_HTML = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</(p|div|tr|br|h[1-6]|li|td|th|dt|dd|blockquote)\s*>', chr(10), 'g'), '(?i)<br\s*/>', chr(10), 'g'), '<[!/]?[A-Za-z][^>]*>', '', 'g')"
_ENTITIES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&copy;?', chr(169), 'g'), '&middot;?', chr(183), 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


@query(f"with t as (select page_id, {_ENTITIES.format(_STRIP_HTML)} as t from pages) select page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, e' \\t\\r\\n\\x0B\\f')), lambda x: x <> ''), chr(10)) as text from t")
def html_text(s: SparkSession, d: str) -> DataFrame:
    return H.texts(table(s, d, "pages"))


@query(f"with t as (select page_id, {_ENTITIES.format(_STRIP_HTML)} as t from pages) select page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, e' \\t\\r\\n\\x0B\\f')), lambda x: x <> ''), chr(10)) as text from t")
def mhtml_text(s: SparkSession, d: str) -> DataFrame:
    files = fx.archives(s, d)
    return I.parse(files).select(F.regexp_extract("filename", r"^(\d+)", 1).cast("long").alias("page_id"), "text")


@query("select p_partkey, trim(p_name) || chr(10) || trim(p_brand) as text, 'docx' as ext from part")
def docx_text(s: SparkSession, d: str) -> DataFrame:
    files = fx.word_files(s, d)
    return I.parse(files).select(F.regexp_extract("filename", r"^(\d+)", 1).cast("long").alias("p_partkey"), "text", "ext")


@query(f"select page_id, {_ENTITIES.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') as site_name from pages")
def html_meta(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.site_name(F.col("url")).alias("site_name"))


@query(
    r"with l as (select page_id, unnest(regexp_extract_all(html, '<a\s+href=\"([^\"]*)\"', 1)) as href from pages) select page_id, count(*) as n_links, count_if(href = '' or href like '#%' or href like 'javascript:%') as n_dropped from l group by 1"
)
def html_links(s: SparkSession, d: str) -> DataFrame:
    return H.links(table(s, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(~F.col("kept")).alias("n_dropped"))


@query()
def html_markdown(s: SparkSession, d: str) -> DataFrame:
    return H.markdown(table(s, d, "pages"))


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(s: SparkSession, d: str) -> DataFrame:
    from ..streaming.jobs import tumbling

    return tumbling(table(s, d, "events"), "1 hour").select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """
with g as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as gap from events),
s as (select *, sum(case when gap < interval 6 hours then 0 else 1 end) over (partition by user_id order by ts) as k from g)
select user_id, min(ts) as first, max(ts) as last, count(*) as n from s group by user_id, k"""
)
def events_session(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    w = F.session_window("ts", "6 hours")
    return e.groupBy("user_id", w).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).select("user_id", "first", "last", "n")


@query("select user_id as job_id, arg_max(event_type, (ts, event_id)) as status, count(*) as n_events from events group by 1")
def stream_job_state(s: SparkSession, d: str) -> DataFrame:
    from ..streaming.jobs import fold_stream

    return fold_stream(s, f"{d}/events.parquet")


@query()
def scheme_registry(s: SparkSession, d: str) -> DataFrame:
    from ..plans.registry import listing

    return listing(s)


@query(
    """
with p as (select page_id, regexp_extract(html, '(?is)<article>(.*?)</article>', 1) as a from pages)
select page_id, length(regexp_replace(regexp_replace(a, '<[!/]?[A-Za-z][^>]*>', '', 'g'), '\\s+', '', 'g')) > 0 as has_article from p"""
)
def html_article(s: SparkSession, d: str) -> DataFrame:
    found = H.content_texts(table(s, d, "pages"))
    return found.select("page_id", (F.col("text") != "").alias("has_article"))


@query(f"with {fx.WORDS}, c as (select doc, page, word_ord, x0 + (word_ord % 4) * 0.5 as cx, top + (word_ord % 3) * 0.4 - 0.4 as cy, word_ord % 17 as size from words), k as (select *, round_even(cx * 10, 0) as gx, round_even(cy * 10, 0) as gy from c), h as (select w.doc, w.page, w.word_ord, arg_min(k.size, (gy - round_even(top * 10, 0), gx - round_even(x0 * 10, 0), -k.word_ord)) as size from words w join k on k.doc = w.doc and k.page = w.page and abs(gy - round_even(top * 10, 0)) <= 5 and gx - round_even(x0 * 10, 0) between -5 and 19 group by 1, 2, 3) select doc, word_ord, size::double as size from h")
def nearest_char(s: SparkSession, d: str) -> DataFrame:
    w = fx.words(s, d)
    k = F.col("word_ord")
    chars = w.select("doc", "page", k.alias("char_ord"), (F.col("x0") + F.pmod(k, F.lit(4)) * 0.5).alias("x0"), (F.col("top") + F.pmod(k, F.lit(3)) * 0.4 - 0.4).alias("top"), F.pmod(k, F.lit(17)).cast("double").alias("size"), F.lit("F").alias("fontname"))
    return L.nearest_char(w, chars).select("doc", "word_ord", "size")


_MARKED = "m as (select (p_partkey // 100)::varchar as doc, 1 + (p_partkey % 100) // 50 as page, p_partkey % 50 as line, p_size::varchar as marker, p_brand, p_partkey as k, length(p_name) as len_name from part)"


@query(f"with {_MARKED} select doc, page, marker, line * 1000 + len_name as char_ord from m")
def footnote_runs(s: SparkSession, d: str) -> DataFrame:
    return N.digit_runs(fx.footnote_chars(s, d).where("top < 800")).select("doc", "page", "marker", "char_ord")


@query(f"with {_MARKED} select doc, marker, min(page) as page, arg_min(line * 1000 + len_name, k) as char_ord from m group by 1, 2")
def footnote_markers(s: SparkSession, d: str) -> DataFrame:
    return N.body_markers(fx.footnote_chars(s, d).where("top < 800"))


@query(
    f"""
with {_MARKED}, n as (select doc, marker, arg_min('note ' || regexp_replace(p_brand, '\\s+\\d{{1,4}}$', ''), k) as definition from m where k % 10 = 3 group by 1, 2),
f as (select doc, marker, min(k) as k from m group by 1, 2)
select doc, marker, definition, (row_number() over (partition by doc order by f.k))::int as place from f join n using (doc, marker)"""
)
def footnote_join(s: SparkSession, d: str) -> DataFrame:
    chars = fx.footnote_chars(s, d)
    pages = chars.select("doc", "page").distinct().withColumn("height", F.lit(1050.0))
    return N.resolved(N.body_markers(chars.where("top < 800")), N.definitions(chars, pages))


@query(
    f"""
with {_MARKED}, n as (select doc, marker, arg_min('note ' || p_brand, k) as definition from m where k % 10 = 3 group by 1, 2),
f as (select doc, marker, min(k) as k from m group by 1, 2),
d as (select m.doc, string_agg('x' || case when n.marker is null then m.marker else '[^' || m.marker || ']' end || ' b', chr(10) order by m.k) as body from m left join n using (doc, marker) group by 1),
t as (select doc, string_agg('[^' || marker || ']: ' || definition, chr(10) order by k) as notes from f join n using (doc, marker) group by 1)
select doc, body || chr(10) || chr(10) || '<!-- ========== FOOTNOTES ========== -->' || chr(10) || chr(10) || notes || chr(10) as text from d join t using (doc)"""
)
def footnote_sections(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    k = F.col("p_partkey")
    doc, marker = F.floor(k / 100).cast("string"), F.col("p_size").cast("string")
    line = F.concat(F.lit("x"), marker, F.lit(" b"))
    docs = p.groupBy(doc.alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    markers = p.groupBy(doc.alias("doc"), marker.alias("marker")).agg(F.lit(1).alias("page"), F.min(k).alias("char_ord"))
    notes = p.where("p_partkey % 10 = 3").groupBy(doc.alias("doc"), marker.alias("marker")).agg(F.concat(F.lit("note "), F.min_by("p_brand", k)).alias("definition"))
    return N.with_footnotes(docs, N.resolved(markers, notes)).join(notes.select("doc").distinct(), "doc", "left_semi")


@query(
    """
with r as (select (o_orderkey // 40)::varchar as doc, o_orderkey as k, (1 + o_custkey % 3)::int as n, 'c' || o_orderkey || ' v' || o_custkey as cell from orders),
m as (select *, n > 1 and coalesce(lag(n) over w <> n, true) as first, n > 1 and coalesce(lead(n) over w <> n, true) as last from r window w as (partition by doc order by k)),
l as (select *, case when n = 1 then cell else '| ' || array_to_string(list_transform(range(n), lambda i: cell), ' | ') || ' |' end as row from m),
c as (select *, case when first then chr(10) || row || chr(10) || '| ' || array_to_string(list_transform(range(n), lambda i: '---'), ' | ') || ' |' else row end || case when last then chr(10) else '' end as chunk from l)
select doc, trim(regexp_replace(string_agg(chunk, chr(10) order by k), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)) as text from c group by doc"""
)
def ocr_markdown(s: SparkSession, d: str) -> DataFrame:
    return G.ocr_markdown(fx.ocr_words(s, d)).select("doc", "text")


@query("with o as (select (o_orderkey // 40)::varchar as doc, (o_orderkey % 40)::int as y, (2 * (1 + o_custkey % 3))::bigint as n from orders) select doc, (row_number() over (partition by doc order by y) - 1)::int as line, n from o")
def ocr_rows(s: SparkSession, d: str) -> DataFrame:
    return G.ocr_rows(fx.ocr_words(s, d)).groupBy("doc", "line").agg(F.count("*").alias("n"))


@query(
    """
select (o_orderkey // 30)::varchar as doc, (row_number() over (partition by o_orderkey // 30 order by o_orderkey))::int as row_ord, '2024-' || strftime(o_orderdate, '%m-%d') as date, o_orderpriority || ' REF' as payee, '' as memo,
  o_totalprice_2 as amount, o_orderstatus = 'F' as credit
from (select *, round_even(o_totalprice, 2) as o_totalprice_2 from orders where o_orderkey % 7 <> 0)"""
)
def deposit_statements(s: SparkSession, d: str) -> DataFrame:
    words = fx.deposit_words(s, d)
    pages = words.select("doc", "page").distinct().withColumn("width", F.lit(fx.DEPOSIT_WIDTH))
    texts = pages.select("doc", F.lit("As at 31 Jan 2024").alias("text"))
    return B.deposit_transactions(B.deposit_rows(words, pages), B.statement_dates(texts).select("doc", "year"))


@query(
    """
with o as (select *, o_orderkey // 20 as b, o_orderkey % 4 as form, month(o_orderdate) as m, round_even(o_totalprice, 2) as a, format('{:,.2f}', o_totalprice) as t from orders)
select b::varchar as doc, (case when m > 3 then '2024-' else '2025-' end) || strftime(o_orderdate, '%m-%d') as date,
  case form when 0 then 'SOME CAFE' when 1 then 'REFUND' when 2 then 'SPLIT NAME CONTINUED 2.00' else 'SHOP' end as payee, case form when 2 then 'U. S. DOLLAR ' || t else '' end as memo,
  case form when 2 then 13.45 else a end as amount, form in (1, 3) as credit from o"""
)
def card_statements(s: SparkSession, d: str) -> DataFrame:
    lines = fx.card_lines(s, d)
    dates = B.statement_dates(lines.select("doc").distinct().withColumn("text", F.lit("dated 23 Mar 2025")))
    return B.card_transactions(lines, dates).drop("row_ord")


@query(
    """
with o as (select o_orderkey, o_orderkey % 3 as k from orders)
select o_orderkey, case k when 0 then 'dbscc' when 1 then 'dbsdeposit' end as parser from o"""
)
def statement_detect(s: SparkSession, d: str) -> DataFrame:
    from .registry import auto_detect

    k = F.pmod("o_orderkey", F.lit(3))
    text = F.when(k == 0, "x\nnew transactions y").when(k == 1, "Details of Transactions  WITHDRAWAL($)\nDEPOSIT($)").otherwise("RENEW TRANSACTIONS")
    return table(s, d, "orders").select("o_orderkey", auto_detect(text).alias("parser"))


@query(f"select payee, category, dict_ord::int as dict_ord, {len(fx.ALIASES)}::bigint as n_aliases from (values {fx.CATEGORY_VALUES}) t(payee, category, dict_ord)")
def lookup_roundtrip(s: SparkSession, d: str) -> DataFrame:
    import uuid

    from ..streaming.jobs import workspace

    path = f"{workspace(s)}/lookup-{uuid.uuid4().hex}"
    counts = B.save_lookup(fx.categories(s), fx.aliases(s), path)
    return B.load_lookup(s, path)[0].withColumn("n_aliases", F.lit(counts["aliases"]).cast("long"))


_ENTRIES = """
e as (select source, doc_id as page, case doc_id % 5 when 0 then 'heuristic' else 'docling' end as engine, case doc_id % 4 when 0 then 'ocr' when 1 then 'mixed' else 'native' end as extraction_method,
  doc_id % 3 as table_count, case when doc_id % 7 = 0 then null else doc_id % 2 end as figure_count from documents)"""


def _entries(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    of = lambda n: F.pmod(k, F.lit(n))
    return table(s, d, "documents").select(
        "source", k.alias("page"), F.when(of(5) == 0, "heuristic").otherwise("docling").alias("engine"),
        F.when(of(4) == 0, "ocr").when(of(4) == 1, "mixed").otherwise("native").alias("extraction_method"), of(3).alias("table_count"), F.when(of(7) != 0, of(2)).alias("figure_count"),
    )


@query(
    f"""
with {_ENTRIES}, t as (select source, count(*) as p, sum(table_count)::bigint as t, coalesce(sum(figure_count), 0)::bigint as f, count_if(extraction_method in ('ocr', 'mixed')) as o, count_if(engine = 'docling') as d, count_if(engine = 'heuristic') as h from e group by 1)
select source, p as n_pages, t as n_tables, f as n_figures, p || ' pages, ' || t || ' tables, ' || f || ' figures' || case when o > 0 then ', ' || o || ' OCR''d' else '' end ||
  case when h > 0 and d > 0 then ', ' || h || ' heuristic-fallback' when h > 0 then ', heuristic engine (Docling unavailable)' when d > 0 then ', Docling engine' else '' end as stats from t"""
)
def transform_stats(s: SparkSession, d: str) -> DataFrame:
    out = G.transform_stats(_entries(s, d), ["source"])
    return out.select("source", "n_pages", "n_tables", "n_figures", F.array_join("stats", ", ").alias("stats"))


@query(
    """
with e as (select user_id % 20 as run, event_id as source, event_type as grade, case when event_id % 5 = 0 then null when event_id % 7 = 0 then null else value end as score from events)
select run, arg_min(grade, source) as mean_grade, arg_min(grade, source) as low_grade, round(avg(score), 6) as mean_score, min(score) as low_score from e group by 1"""
)
def docling_summary(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    score = F.when(F.pmod(k, F.lit(5)) == 0, None).when(F.pmod(k, F.lit(7)) == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    e = table(s, d, "events").select(F.pmod("user_id", F.lit(20)).alias("run"), k.alias("source"), F.col("event_type").alias("mean_grade"), F.col("event_type").alias("low_grade"), score.alias("mean_score"), score.alias("low_score"))
    return G.merged_summary(e, ["run"]).withColumn("mean_score", F.round("mean_score", 6))


@query(
    """
with p as (select source as doc, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as total, n_chars % 40 as n from documents),
s as (select *, least(total, 10) as k, greatest(1, total // least(total, 10)) as stride from p)
select doc, total as page_count, avg((n < 20)::int) filter (i % stride = 0 and i // stride < k) > 0.5 as ocr_expected from s group by doc, total"""
)
def pdf_probe(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    pages = table(s, d, "documents").select(F.col("source").alias("doc"), place.alias("page"), F.pmod("n_chars", F.lit(40)).alias("n_chars"))
    return G.probe(pages)


@query(
    f"""
with t as (select page_id, {_ENTITIES.format(_STRIP_HTML)} as t from pages),
x as (select page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, e' \\t\\r\\n\\x0B\\f')), lambda x: x <> ''), chr(10)) as text from t)
select page_id // 4 as request_id, count(*) as n, case count(*) when 1 then any_value(text) else string_agg('=== ' || page_id || '.html ===' || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_id::varchar || '.html') end as text from x group by 1"""
)
def extract_consolidated(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pages")
    files = p.select(F.floor(F.col("page_id") / 4).alias("request_id"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.encode("html", "UTF-8").alias("content"), F.col("page_id").alias("file_ord"))
    out = E.extract(files).select("request_id", F.get_json_object("json", "$.text").alias("text"))
    n = files.groupBy("request_id").agg(F.count("*").alias("n"))
    return out.join(n, "request_id")


def _archive_requests(s: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("filename", r"^(\d+)", 1).cast("long")
    return fx.archives(s, d).select(F.floor(k / 3).alias("request_id"), "filename", "content", k.alias("file_ord"))


@query("select page_id // 3 as request_id, count(*)::int as file_count, string_agg(page_id || '.md', ',' order by page_id::varchar || '.md') as names from pages group by 1")
def extract_individual(s: SparkSession, d: str) -> DataFrame:
    out = E.extract(_archive_requests(s, d), "mhtml2md", "individual")
    names = F.from_json(F.get_json_object("json", "$.files"), "array<struct<filename:string>>")
    return out.select("request_id", F.get_json_object("json", "$.file_count").cast("int").alias("file_count"), F.array_join(F.transform(names, lambda x: x["filename"]), ",").alias("names"))


@query("with n as (select page_id // 3 as request_id, count(*) as n from pages group by 1), t as (select request_id, unnest(list_concat(list_transform(range(1, n + 1), lambda i: {'seq': i, 'type': 'progress'}), [{'seq': n + 1, 'type': 'processing'}, {'seq': n + 2, 'type': 'result'}])) as e from n) select request_id, e.seq::int as seq, e.type as type from t")
def progress_events(s: SparkSession, d: str) -> DataFrame:
    return E.events(_archive_requests(s, d), "mhtml2md").select("request_id", "seq", "type")


@query(
    """
with p as (select doc_id // 20 as doc, doc_id as page, text, quality from documents left join labels using (doc_id)),
m as (select doc, page, text, array_to_string(list_filter([trim(text, e' \\t\\r\\n\\x0B\\f'), case when quality = 1 then '| Key |' || chr(10) || '| --- |' || chr(10) || '| ' || page || ' |' else '' end], lambda x: x <> ''), chr(10) || chr(10)) as md, coalesce(quality, 0) as q from p)
select doc, coalesce(string_agg(text, chr(10) || chr(10) order by page) filter (trim(text, e' \\t\\r\\n\\x0B\\f') <> ''), '') as plain_text, coalesce(string_agg(md, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page) filter (md <> ''), '') as markdown, sum(q)::bigint as table_count from m group by doc"""
)
def structured_documents(s: SparkSession, d: str) -> DataFrame:
    doc = F.floor(F.col("doc_id") / 20)
    pages = table(s, d, "documents").select(doc.alias("doc"), F.col("doc_id").alias("page"), "text")
    key = F.array(F.array(F.col("doc_id").cast("string")))
    tables = table(s, d, "labels").where("quality = 1").select(doc.alias("doc"), F.col("doc_id").alias("page"), F.lit(0).alias("table_ord"), F.array(F.lit("Key")).alias("headers"), key.alias("rows"))
    return G.structured_documents(pages, tables).drop("json")


@query(
    """
with f as (select (vec_id // 25)::varchar as doc, 1 + vec_id % 25 as pic_ord, label as page, case when vec_id % 6 = 0 then 40 else 64 end as width, 64 as height, case when vec_id % 11 = 0 then '' else (vec_id % 9)::varchar end as hash from embeddings),
b as (select *, width * height >= 4096 as big from f),
z as (select doc, hash from b where big and hash <> '' group by 1, 2 having count(distinct page) >= 3),
k as (select b.*, big and z.hash is null as kept from b left join z using (doc, hash))
select doc, pic_ord, case when kept then 'figure-' || sum(kept::int) over (partition by doc order by pic_ord) || '-p' || page || '-d' || doc || '.png' end as filename from k"""
)
def figure_filter(s: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id")
    doc = F.floor(k / 25).cast("string")
    figures = table(s, d, "embeddings").select(
        doc.alias("doc"), (1 + F.pmod(k, F.lit(25))).alias("pic_ord"), F.col("label").alias("page"), F.when(F.pmod(k, F.lit(6)) == 0, 40).otherwise(64).alias("width"), F.lit(64).alias("height"),
        F.when(F.pmod(k, F.lit(11)) == 0, "").otherwise(F.pmod(k, F.lit(9)).cast("string")).alias("hash"),
    )
    return G.kept_figures(figures, figures.select("doc").distinct().withColumn("stem", F.concat(F.lit("d"), "doc"))).select("doc", "pic_ord", "filename")


@query(
    """
with t as (select c_custkey // 10 as doc, list(c_custkey order by c_custkey) as k from customer group by 1)
select doc::varchar as doc, 'a ' || array_to_string(list_transform(k, lambda x: case when x % 3 = 0 then '*[figure filtered]*' else '![Figure ' || len(list_filter(k, lambda y: y <= x and y % 3 <> 0)) || '][fig' || len(list_filter(k, lambda y: y <= x and y % 3 <> 0)) || ']' end), ' b ') || ' b <!-- image -->' || chr(10) || chr(10) ||
  '<!-- ========== FIGURES ========== -->' || chr(10) || chr(10) || array_to_string(list_transform(list_filter(k, lambda y: y % 3 <> 0), lambda x, i: '<!-- fig' || i || ': page 7 -->' || chr(10) || '[fig' || i || ']: data:image/png;base64,' || to_base64(encode('png' || x))), chr(10)) || chr(10) as text from t where len(list_filter(k, lambda y: y % 3 <> 0)) > 0"""
)
def figure_references(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    doc = F.floor(k / 10).cast("string")
    figures = c.select(doc.alias("doc"), k.alias("pic_ord"), F.when(F.pmod(k, F.lit(3)) != 0, F.concat(F.lit("f"), k.cast("string"), F.lit(".png"))).alias("filename"), F.lit(7).cast("long").alias("page"), F.encode(F.concat(F.lit("png"), k.cast("string")), "UTF-8").alias("content"))
    docs = figures.groupBy("doc").agg(F.concat(F.lit("a "), F.repeat(F.lit("<!--  IMAGE --> b "), F.count("*").cast("int")), F.lit("<!-- image -->")).alias("text"))
    return G.inject_figures(docs, figures)


@query("select p_partkey, case p_partkey % 4 when 3 then null else p_size::double end as x0, case p_partkey % 4 when 3 then null else p_size + 9.0 end as y1 from part")
def bbox_layouts(s: SparkSession, d: str) -> DataFrame:
    k, x = F.pmod("p_partkey", F.lit(4)), F.col("p_size").cast("double")
    of = lambda *names: F.create_map(*[v for n, j in zip(names, (0.0, 1.0, 2.0, 9.0)) for v in (F.lit(n), (x + j).cast("string"))])
    bbox = F.when(k == 0, of("x0", "y0", "x1", "y1")).when(k == 1, of("x1", "y1", "x2", "y2")).when(k == 2, of("left", "top", "right", "bottom")).otherwise(of("a", "b", "c", "d"))
    box = L.box(bbox)
    return table(s, d, "part").select("p_partkey", F.get(box, F.lit(0)).alias("x0"), F.get(box, F.lit(3)).alias("y1"))


@query(
    r"""
with n as (select page_id, case page_id % 3 when 0 then 'A b' || page_id || '.PDF' when 1 then 'x' || page_id || '.Mhtml' else 'read.me' || page_id end as name, url || '/?q=1#Top' as link from pages)
select page_id, case page_id % 3 when 0 then 'A b' || page_id || '.md' else name || '.md' end as pdf_name, case page_id % 3 when 1 then 'x' || page_id || '.md' else name end as mhtml_name,
  case page_id % 3 when 0 then 'A_b' || page_id when 1 then 'x' || page_id else 'read' end as stem, case page_id % 3 when 0 then 'A_b' || page_id else name end as pdf_stem,
  case page_id % 3 when 0 then '.pdf' when 1 then '.mhtml' end as kind, lower(regexp_replace(split_part(split_part(link, '?', 1), '#', 1), '/+$', '')) as core from n"""
)
def file_names(s: SparkSession, d: str) -> DataFrame:
    from .registry import file_type

    key, k = F.col("page_id").cast("string"), F.pmod("page_id", F.lit(3))
    name = F.when(k == 0, F.concat(F.lit("A b"), key, F.lit(".PDF"))).when(k == 1, F.concat(F.lit("x"), key, F.lit(".Mhtml"))).otherwise(F.concat(F.lit("read.me"), key))
    return table(s, d, "pages").select(
        "page_id", T.markdown_name(name, "pdf2md").alias("pdf_name"), T.markdown_name(name, "mhtml2md").alias("mhtml_name"), T.safe_stem(name).alias("stem"), T.safe_stem(name, None).alias("pdf_stem"),
        file_type(name).alias("kind"), T.url_core(F.concat("url", F.lit("/?q=1#Top"))).alias("core"),
    )


@query(
    """
with p as (select p_partkey as k, p_name as name, p_size as n from part)
select k, repeat('#', greatest(1, least(4, n % 7))) || ' ' || name as heading, k % 4 in (0, 1, 2) as is_item, case when k % 4 = 3 then 'x ' || name else name end as item, k % 3 <> 2 as numbering,
  round(case k % 4 when 0 then n::double when 1 then n::double * 1.333::double when 2 then n * 16.0 end, 6) as px, name || chr(10) || chr(10) || 'b' as collapsed, 3 as n_lines from p"""
)
def markdown_marks(s: SparkSession, d: str) -> DataFrame:
    k, name, n = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    four, three = F.pmod(k, F.lit(4)), F.pmod(k, F.lit(3))
    item = F.when(four == 0, F.concat(F.lit("\u2022 "), name)).when(four == 1, F.concat(F.lit(" 12) "), name)).when(four == 2, F.concat(F.lit("b. "), name)).otherwise(F.concat(F.lit("x "), name))
    number = F.when(three == 0, "1.2.").when(three == 1, "iv)").otherwise(name)
    style = F.when(four == 0, F.format_string("font-size: %dpx", n)).when(four == 1, F.format_string("FONT-SIZE:%d.0 pt", n)).when(four == 2, F.format_string("color:red;font-size:%dem", n)).otherwise("margin:0")
    return table(s, d, "part").select(
        k.alias("k"), T.heading(F.pmod(n, F.lit(7)), name).alias("heading"), T.is_list_item(item).alias("is_item"), T.drop_list_marker(item).alias("item"), T.is_numbering(number).alias("numbering"), F.round(T.font_size_px(style), 6).alias("px"),
        T.collapse_blank_lines(F.concat(F.lit("\n"), name, F.lit("\n \n\n\t\nb\n"))).alias("collapsed"), F.size(T.splitlines(F.concat(name, F.lit("\r\nb\u2028c\n")))).alias("n_lines"),
    )
