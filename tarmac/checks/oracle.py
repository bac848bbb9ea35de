"""The registered queries once more, as SQL for another engine.

These are written independently of the DataFrame code: joins and windows where that uses
single aggregations, full sorts where that counts hash prefixes.
"""

from __future__ import annotations

from collections.abc import Callable


def _half_up(x: str, digits: int = 2) -> str:
    return (
        f"cast(cast(round(cast({x} as decimal(30,12)), {digits}) as decimal(10,{digits}))"
        " as double)"
    )


def _exact_half_up(total: str, count: str, digits: int = 2) -> str:
    """Half-up of a quotient in whole numbers; ``total`` counts millionths."""
    scale = 10**digits
    part = f"cast({total} as hugeint)"
    number = f"cast({count} as hugeint)"
    whole = f"((2 * {scale} * abs({part}) + 1000000 * {number}) // (2000000 * {number}))"
    return (
        f"case when {count} > 0 then cast(cast(sign({part}) * {whole} as bigint) as double) "
        f"/ {scale} end"
    )


def _mean(value: str, where: str = "") -> str:
    """Rounded mean of a column over the rows that ``where`` keeps."""
    kept = f" filter (where {where})" if where else ""
    return _exact_half_up(
        f"sum(cast(round({value} * 1000000) as hugeint)){kept}", f"count({value}){kept}"
    )


def _rate(part: str, whole: str) -> str:
    return _exact_half_up(f"100000000 * {part}", whole, 1)


LINES = """
lines as (
  select l.*, n_name, c_nationkey,
         l_quantity * 3 - 30 as dd,
         case when (l_returnflag = 'R' and l_linenumber = 7)
                or (l_suppkey % 15 = 0 and c_nationkey % 5 = 0)
                or c_nationkey = 7 then 1 else 0 end as canc
  from lineitem l
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey
)"""

FLIGHTS = (
    LINES
    + """,
flights as (
  select cast(month(l_shipdate) as bigint) as month,
         l_shipdate as fl_date,
         'C' || lpad(cast(l_suppkey % 15 as varchar), 2, '0') as op_unique_carrier,
         cast(l_orderkey as double) as op_carrier_fl_num,
         n_name as origin,
         'D' || cast(l_partkey % 40 as varchar) as dest,
         case when canc = 0 then dd end as dep_delay,
         case when canc = 0 and l_partkey % 97 <> 0
              then dd + (l_partkey % 21) - 14 end as arr_delay,
         cast(canc as bigint) as cancelled,
         case when (canc = 1 and l_partkey % 13 <> 0) or (canc = 0 and l_partkey % 101 = 0)
              then substr('ABCD', cast(l_partkey % 4 as int) + 1, 1) end as cancellation_code,
         case when canc = 0 and dd > 15 and l_partkey % 3 = 0 then 5.0::double else 0.0::double end
           as carrier_delay,
         case when canc = 0 and dd > 15 and l_partkey % 11 = 0 then 7.0::double else 0.0::double end
           as weather_delay,
         case when canc = 0 and dd > 15 and l_partkey % 2 = 0 then 9.0::double else 0.0::double end
           as nas_delay,
         case when canc = 0 and dd > 15 and l_partkey % 53 = 0 then 3.0::double else 0.0::double end
           as security_delay,
         case when canc = 0 and dd > 15 and l_partkey % 3 = 1 then 11.0::double else 0.0::double end
           as late_aircraft_delay
  from lines
)"""
)


def _text_minutes(minutes: str, hit: str) -> str:
    return (
        "case when l_partkey % 5 = 0 then null when l_partkey % 7 = 0 then 'abc' "
        f"when canc = 0 and dd > 15 and {hit} then '{minutes}' else '0.0' end"
    )


RAW = (
    FLIGHTS
    + f""",
raw as (
  select cast(2024 as bigint) as year,
         cast(case when canc = 0 and l_partkey % 97 = 0 then 1 else 0 end as bigint) as diverted,
         cast(month(l_shipdate) as bigint) as month,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as fl_date,
         'C' || lpad(cast(l_suppkey % 15 as varchar), 2, '0') as op_unique_carrier,
         cast(l_orderkey as double) as op_carrier_fl_num,
         n_name as origin,
         'D' || cast(l_partkey % 40 as varchar) as dest,
         case when canc = 0 and (l_partkey % 89 <> 0 or l_partkey % 97 = 0) then dd end
           as dep_delay,
         case when canc = 0 and l_partkey % 97 <> 0
              then dd + (l_partkey % 21) - 14 end as arr_delay,
         cast(case when l_partkey % 211 = 0 then 2 when l_partkey % 223 = 0 then null
              else canc end as bigint) as cancelled,
         case when (canc = 1 and l_partkey % 13 <> 0) or (canc = 0 and l_partkey % 101 = 0)
              then substr('ABCD', cast(l_partkey % 4 as int) + 1, 1) end as cancellation_code,
         {_text_minutes("5.0", "l_partkey % 3 = 0")} as carrier_delay,
         {_text_minutes("7.0", "l_partkey % 11 = 0")} as weather_delay,
         {_text_minutes("9.0", "l_partkey % 2 = 0")} as nas_delay,
         case when canc = 0 and dd > 15 and l_partkey % 53 = 0 then 3.0::double else 0.0::double end
           as security_delay,
         case when canc = 0 and dd > 15 and l_partkey % 3 = 1 then 11.0::double else 0.0::double end
           as late_aircraft_delay
  from lines
)"""
)

FLIGHT_COLUMNS = (
    "month, fl_date, op_unique_carrier, op_carrier_fl_num, origin, dest, dep_delay, arr_delay, "
    "cancelled, cancellation_code"
)
TEXT_CAUSES = ("carrier_delay", "weather_delay", "nas_delay")
NUMBER_CAUSES = ("security_delay", "late_aircraft_delay")
IMPUTED = ", ".join(
    [f"coalesce(try_cast({c} as double), 0) as {c}" for c in TEXT_CAUSES] + list(NUMBER_CAUSES)
)

# --- report 3.1 -----------------------------------------------------------------------


def _route_month(source: str, empty: str = "null") -> str:
    flown = "arr_delay) filter (where cancelled = 0"
    return f"""
  select op_unique_carrier as codice, origin as aeroporto_partenza,
         count(*) as numero_voli,
         coalesce(min({flown}), 0.0::double) as ritardo_minimo,
         coalesce(max({flown}), 0.0::double) as ritardo_massimo,
         coalesce({_mean("arr_delay", "cancelled = 0")}, {empty}) as ritardo_medio,
         {_rate("count(*) filter (where cancelled = 1)", "count(*)")}
           as tasso_cancellazione,
         month as mese
  from {source}
  group by op_unique_carrier, origin, month"""


# --- report 3.2 -----------------------------------------------------------------------

CAUSES = {
    "Carrier": ("carrier_delay", "A"),
    "Weather": ("weather_delay", "B"),
    "NAS": ("nas_delay", "C"),
    "Security": ("security_delay", "D"),
    "Late Aircraft": ("late_aircraft_delay", None),
}


def _cause_rows(on_cancelled_only: bool = False) -> str:
    extra = " and cancelled <> 0" if on_cancelled_only else ""
    branches = []
    for name, (minutes, code) in CAUSES.items():
        branches.append(
            f"select origin, month, '{name}' as causa from flights "
            f"where cancelled = 0 and {minutes} > 0"
        )
        if code:
            branches.append(
                f"select origin, month, '{name}' as causa from flights "
                f"where cancellation_code = '{code}'{extra}"
            )
    hits = "\n  union all ".join(branches)
    return f"""
hits as ({hits}),
counted as (select origin, month, causa, count(*) as frequenza from hits group by all),
ranked as (
  select *, row_number() over (partition by origin, month order by frequenza desc, causa) as rk
  from counted
)"""


BANDS = {
    "basso": ("numero_ritardi_basso", "dep_delay < 15"),
    "medio": ("numero_ritardi_medio", "dep_delay between 15 and 60"),
    "alto": ("numero_ritardo_alto", "dep_delay > 60"),
}


def _band_columns(empty: str = "null") -> str:
    columns = []
    for suffix, (number, inside) in BANDS.items():
        where = f"cancelled = 0 and {inside}"
        columns += [
            f"count(*) filter (where {where}) as {number}",
            f"coalesce({_mean('dep_delay', where)}, {empty}) as dep_avg_{suffix}",
            f"coalesce({_mean('arr_delay', where)}, {empty}) as arr_avg_{suffix}",
        ]
    return ",\n         ".join(columns)


def _delay_bands(
    empty: str = "null", on_cancelled_only: bool = False, flights: str = FLIGHTS
) -> str:
    return f"""
with {flights},{_cause_rows(on_cancelled_only)},
labels as (
  select origin, month,
         '"[' || string_agg('''' || causa || ' (' || frequenza || ' voli)''', ', ' order by rk)
           || ']"' as label
  from ranked where rk <= 3 group by origin, month
),
bands as (
  select origin as aeroporto_partenza, month as mese,
         {_band_columns(empty)}
  from flights group by origin, month
)
select bands.*, coalesce(label, '"[]"') as cause_maggiori
from bands left join labels on aeroporto_partenza = origin and mese = month"""


# --- report 3.3 -----------------------------------------------------------------------


def _carriers(
    gap: str = "rounded", empty: str = "null", nulls: str = "first", drop_airports: bool = False
) -> str:
    """CTEs ending in ``report``; means are kept unrounded next to the rounded ones."""
    differences = {
        "rounded": f"cast(ritardo_medio_partenza as decimal(10,2))"
        " - cast(airport_shown as decimal(10,2))",
        "exact": "carrier_mean - airport_mean",
        "mixed": "ritardo_medio_partenza - airport_mean",
    }
    return f"""
airports as (
  select origin, avg(dep_delay) filter (where cancelled = 0) as airport_mean,
         {_mean("dep_delay", "cancelled = 0")} as airport_shown
  from flights group by origin
),
carriers as (
  select origin, op_unique_carrier, count(*) as numero_voli,
         coalesce(avg(dep_delay) filter (where cancelled = 0), {empty}) as carrier_mean,
         coalesce({_mean("dep_delay", "cancelled = 0")}, {empty}) as carrier_shown,
         coalesce({_mean("arr_delay", "cancelled = 0")}, {empty}) as arrival_shown,
         {_rate("count(*) filter (where cancelled = 1)", "count(*)")} as rate
  from flights group by origin, op_unique_carrier
),
shown as (
  select carriers.*, airport_mean, airport_shown, carrier_shown as ritardo_medio_partenza
  from carriers join airports using (origin)
  {"where airport_mean is not null" if drop_airports else ""}
),
report as (
  select origin as aeroporto_partenza, op_unique_carrier as compagnia, numero_voli,
         ritardo_medio_partenza,
         arrival_shown as ritardo_medio_arrivo,
         rate as tasso_cancellazione,
         {_half_up(differences[gap])} as differenza,
         cast(row_number() over (
           partition by origin
           order by ritardo_medio_partenza asc nulls {nulls}, op_unique_carrier) as int)
           as classifica
  from shown
)"""


# --- cleaning -------------------------------------------------------------------------

CORRUPT = (
    "coalesce(cancelled = 0 and diverted = 0 and (arr_delay is null or dep_delay is null), false)"
)
OUTLIER = (
    "coalesce(dep_delay < -30 or dep_delay > 110 or arr_delay < -30 or arr_delay > 110, false)"
)


def _null_counts(source: str, columns: list[str], where: str = "true") -> str:
    return "\nunion all ".join(
        f"select '{c}' as column_name, count(*) filter (where {c} is null) as nulls "
        f"from {source} where {where}"
        for c in columns
    )


RAW_COLUMNS = (
    ["year", "diverted"] + FLIGHT_COLUMNS.split(", ") + list(TEXT_CAUSES) + list(NUMBER_CAUSES)
)

def _raw_text(column: str) -> str:
    text = f"coalesce(cast({column} as varchar), '')"
    damage = {"dep_delay": "when late then 'late'", "cancelled": "when two then '2'"}.get(column)
    return f"case {damage} else {text} end" if damage else text


# --- samples --------------------------------------------------------------------------

ORDER_HASH = "md5('42|' || cast(o_orderkey as varchar))"
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _orders_ranked() -> str:
    return (
        f"ranked as (select *, row_number() over (order by {ORDER_HASH}) as rn, "
        "count(*) over () as total from orders)"
    )


def _sample(fraction: float) -> str:
    return (
        f"with {_orders_ranked()} select {ORDER_COLUMNS} from ranked "
        f"where rn <= round_even({fraction}::double * total, 0)"
    )


FLIGHT_HASH = (
    "md5(concat_ws('|', '42', "
    + ", ".join(
        f"coalesce(cast({c} as varchar), '\\N')"
        for c in FLIGHT_COLUMNS.split(", ") + list(TEXT_CAUSES) + list(NUMBER_CAUSES)
    )
    + "))"
)


def _flight_sample(fraction: float, name: str) -> str:
    return (
        f"hashed as (select *, {FLIGHT_HASH} as h from flights),\n"
        "placed as (select *, row_number() over (order by h) as rn, count(*) over () as total "
        f"from hashed),\n{name} as (select * exclude (h, rn, total) from placed "
        f"where rn <= round_even({fraction}::double * total, 0))"
    )


def _at_scales(report: Callable[[str], str]) -> str:
    """The report of every scaled set, told apart by ``scale``; ``report`` gets a CTE of flights."""
    parts = []
    for scale in (10, 25, 50, 75, 100, 150):
        rows = "select * exclude (h, rn, total) from placed"
        some = f"{rows} where rn <= round_even({scale % 100} / 100.0::double * total, 0)"
        whole, rest = [rows] * (scale // 100), [some] if scale % 100 else []
        scaled = f"flights as ({' union all '.join(whole + rest)})"
        parts.append(f"select {scale} as scale, * from ({report(scaled)})")
    return (
        f"with {FLIGHTS},\nhashed as (select *, {FLIGHT_HASH} as h from flights),\n"
        "placed as materialized (select *, row_number() over (order by h) as rn, "
        "count(*) over () as total from hashed)\n" + "\nunion all ".join(parts)
    )


FEW = "origin, month, cancelled"


def _few_hash(columns: str) -> str:
    texts = ", ".join(f"coalesce(cast({c} as varchar), '\\N')" for c in columns.split(", "))
    return f"md5(concat_ws('|', '42', {texts}))"


def _identical_sample(per: str = "") -> str:
    return f"""with {FLIGHTS},
hashed as (select {FEW}, {_few_hash(FEW)} as h from flights),
placed as (select *, row_number() over ({per} order by h, {FEW}) as rn,
                  count(*) over ({per}) as total from hashed)
select {FEW} from placed where rn <= round_even(0.25::double * total, 0)"""


# --- comparisons ----------------------------------------------------------------------

ROUTE_MEASURES = [
    "numero_voli",
    "ritardo_minimo",
    "ritardo_massimo",
    "ritardo_medio",
    "tasso_cancellazione",
]
ROUTE_KEY = ["codice", "aeroporto_partenza", "mese"]
CARRIER_MEASURES = [
    "numero_voli",
    "ritardo_medio_partenza",
    "ritardo_medio_arrivo",
    "tasso_cancellazione",
    "differenza",
    "classifica",
]
CARRIER_KEY = ["aeroporto_partenza", "compagnia"]


def _pairs(keys: list[str], measures: list[str]) -> str:
    on = " and ".join(f"a.{k} is not distinct from b.{k}" for k in keys)
    columns = [f"coalesce(a.{k}, b.{k}) as {k}" for k in keys]
    columns += [f"a.{m} as {m}_a, b.{m} as {m}_b" for m in measures]
    return (
        f"pairs as (select {', '.join(columns)}, a.tag as in_a, b.tag as in_b "
        f"from (select *, 1 as tag from version_a) a "
        f"full outer join (select *, 1 as tag from version_b) b on {on})"
    )


def _cell_differs(m: str, tolerance: float) -> str:
    wide = "decimal(30,12)"
    return (
        f"({m}_a is distinct from {m}_b and coalesce(abs(cast({m}_a as {wide}) - "
        f"cast({m}_b as {wide})) > cast({tolerance} as {wide}), true))"
    )


def _summary(job: str, measures: list[str], tolerance: float, per_column: bool = True) -> str:
    both = "in_a = 1 and in_b = 1"
    counters = {
        m: f"count(*) filter (where {both} and {_cell_differs(m, tolerance)})" for m in measures
    }
    columns = ", ".join(f"{c} as diff_{m}" for m, c in counters.items())
    total = " + ".join(f"diff_{m}" for m in measures)
    tail = ", " + ", ".join(f"diff_{m}" for m in measures) if per_column else ""
    return f"""
counts as (
  select count(in_a) as rows_a, count(in_b) as rows_b,
         count(*) filter (where in_b is null) as only_a,
         count(*) filter (where in_a is null) as only_b,
         {columns}
  from pairs
)
select '{job}' as job, rows_a, rows_b, rows_a = rows_b as same_length, only_a, only_b,
       cast(0 as bigint) as repeated_keys, {total} as diff_cells,
       case when rows_a <> rows_b then 'different row counts'
            when only_a + only_b > 0 then 'different keys'
            when {total} > 0 then 'different cells' else 'identical' end as verdict{tail}
from counts"""


def _cell_rows(keys: list[str], measures: list[str], tolerance: float) -> str:
    return "\nunion all ".join(
        f"select {', '.join(keys)}, '{m}' as column_name, {_as_text(m + '_a')} as value_a, "
        f"{_as_text(m + '_b')} as value_b from pairs "
        f"where in_a = 1 and in_b = 1 and {_cell_differs(m, tolerance)}"
        for m in measures
    )


def _as_text(column: str) -> str:
    kinds = {"ritardo_medio_partenza": 2, "ritardo_medio_arrivo": 2, "differenza": 2}
    digits = kinds.get(column[:-2], 1 if column.startswith("tasso") else None)
    if digits is None:
        return f"cast({column} as varchar)"
    return f"cast(cast({column} as decimal(10,{digits})) as varchar)"


FULL_AND_HALF = f"""with {FLIGHTS},
{_flight_sample(0.5, "half")},
version_a as ({_route_month("flights")}),
version_b as ({_route_month("half")}),
{_pairs(ROUTE_KEY, ROUTE_MEASURES)}"""

ROUNDED_AND_EXACT = f"""with {FLIGHTS},
version_a as (with {_carriers("rounded")} select * from report),
version_b as (with {_carriers("exact")} select * from report),
{_pairs(CARRIER_KEY, CARRIER_MEASURES)}"""

ROUTE_PAIR = ["codice", "aeroporto_partenza"]
ROUTE_REST = [*ROUTE_MEASURES, "mese"]


def _grouped_side(source: str) -> str:
    columns = [f"max({m}) as {m}, list_sort(list({m})) as all_{m}" for m in ROUTE_REST]
    return f"(select {', '.join(ROUTE_PAIR)}, count(*) as n, {', '.join(columns)} from {source} group by all)"


REPEATED = f"""with {FLIGHTS},
inside as (select * from flights where not {OUTLIER}),
full_a as ({_route_month("flights")}),
full_b as ({_route_month("inside")}),
version_a as (select * from full_a where (codice >= 'C05' or mese = 1)
              and aeroporto_partenza <> 'FRANCE'),
version_b as (select * from full_b where (codice >= 'C05' or mese = 1) and codice <> 'C03'),
pairs as (
  select {', '.join(f'coalesce(a.{k}, b.{k}) as {k}' for k in ROUTE_PAIR)},
         coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b,
         {', '.join(f'a.{m} as {m}_a, b.{m} as {m}_b, a.all_{m} is distinct from b.all_{m} as other_{m}' for m in ROUTE_REST)}
  from {_grouped_side("version_a")} a
  full outer join {_grouped_side("version_b")} b using ({', '.join(ROUTE_PAIR)})
)"""


def _repeated_summary() -> str:
    single = "n_a = 1 and n_b = 1"
    counters = {
        m: f"count(*) filter (where {single} and {_cell_differs(m, 0.01)})" for m in ROUTE_REST
    }
    total = " + ".join(f"diff_{m}" for m in ROUTE_REST)
    return f"""{REPEATED},
counts as (
  select cast(sum(n_a) as bigint) as rows_a, cast(sum(n_b) as bigint) as rows_b,
         count(*) filter (where n_b = 0) as only_a, count(*) filter (where n_a = 0) as only_b,
         count(*) filter (where n_a > 1 or n_b > 1) as repeated_keys,
         {', '.join(f'{c} as diff_{m}' for m, c in counters.items())}
  from pairs
)
select '3.1 by route' as job, rows_a, rows_b, rows_a = rows_b as same_length, only_a, only_b,
       repeated_keys, {total} as diff_cells,
       case when rows_a <> rows_b then 'different row counts'
            when repeated_keys > 0 then 'repeated keys'
            when only_a + only_b > 0 then 'different keys'
            when {total} > 0 then 'different cells' else 'identical' end as verdict,
       {', '.join(f'diff_{m}' for m in ROUTE_REST)}
from counts"""


def _repeated_cells() -> str:
    keys = ", ".join(ROUTE_PAIR)
    rows = [
        f"select {keys}, '(row)' as column_name, cast(n_a as varchar) as value_a, "
        "cast(n_b as varchar) as value_b from pairs where n_a <> 1 or n_b <> 1"
    ]
    for m in ROUTE_REST:
        rows.append(
            f"select {keys}, '{m}', cast({m}_a as varchar), cast({m}_b as varchar) from pairs "
            f"where (n_a = 1 and n_b = 1 and {_cell_differs(m, 0.01)}) "
            f"or ((n_a > 1 or n_b > 1) and n_a > 0 and n_b > 0 and other_{m})"
        )
    return f"{REPEATED} " + " union all ".join(rows)


def _paired_cells() -> str:
    pair, rest = ", ".join(ROUTE_PAIR), ", ".join(f"{m} nulls first" for m in ROUTE_REST)
    sides = [
        f"numbered_{x} as (select *, row_number() over (partition by {pair} order by {rest}) "
        f"as occurrence from version_{x})"
        for x in "ab"
    ]
    keys = ", ".join(
        f"coalesce(a.{k}, b.{k}) as {k}" for k in [*ROUTE_PAIR, "occurrence"]
    )
    both = ", ".join(f"a.{m} as {m}_a, b.{m} as {m}_b" for m in ROUTE_REST)
    joined = (
        f"places as (select {keys}, {both}, a.occurrence is not null as in_a, "
        "b.occurrence is not null as in_b from numbered_a a full outer join numbered_b b "
        f"using ({pair}, occurrence))"
    )
    rows = [
        f"select {pair}, occurrence, '(row)' as column_name, cast(in_a::int as varchar) as value_a, "
        "cast(in_b::int as varchar) as value_b from places where not (in_a and in_b)"
    ]
    for m in ROUTE_REST:
        rows.append(
            f"select {pair}, occurrence, '{m}', cast({m}_a as varchar), cast({m}_b as varchar) "
            f"from places where in_a and in_b and {_cell_differs(m, 0.01)}"
        )
    head = REPEATED[: REPEATED.index("pairs as (")]
    return f"{head}{', '.join(sides)}, {joined} " + " union all ".join(rows)


# --- runs -----------------------------------------------------------------------------

RUNS = """
runs as (
  select '3.' || cast(user_id % 3 + 1 as varchar) as analysis,
         (['Hive', 'Spark_SQL', 'Spark_Core', 'MapReduce'])[cast(user_id % 4 as int) + 1] as tech,
         ([10, 25, 50, 75, 100, 150])[cast(hour(ts) % 6 as int) + 1] as pct,
         case when event_type in ('view', 'error') then 'Locale' else 'Cluster' end as env,
         cast(value as decimal(12,2)) as seconds, event_id
  from events
),
firsts as (
  select analysis, tech, pct,
         cast(first(seconds order by event_id) filter (where env = 'Locale') as double) as a,
         cast(first(seconds order by event_id) filter (where env = 'Cluster') as double) as b
  from runs group by analysis, tech, pct
)"""


def _env_mean(env: str) -> str:
    """Mean to sixteen places in whole numbers; seconds are never negative."""
    here = f"filter (where env = '{env}' and seconds is not null)"
    n = f"cast(count(*) {here} as hugeint)"
    cents = f"cast(sum(cast(seconds * 100 as bigint)) {here} as hugeint)"
    places = f"((2 * {cents} * 100000000000000 + {n}) // (2 * {n}))"
    one = "cast(10000000000000000 as hugeint)"
    return (
        f"case when count(*) {here} > 0 then cast(cast({places} // {one} as varchar) || '.' "
        f"|| lpad(cast({places} % {one} as varchar), 16, '0') as double) end"
    )


def _run_means(keys: str, where: str = "true") -> str:
    return (
        f"means as (select {keys}, {_env_mean('Locale')} as a, {_env_mean('Cluster')} as b "
        f"from runs where {where} group by {keys})"
    )


SPEEDUP = _half_up("a / nullif(b, 0)")
PERCENTS = (10, 25, 50, 75, 100, 150)


def _by_percent(value: str, default: str = "") -> str:
    cells = [f"max({value}) filter (where pct = {p})" for p in PERCENTS]
    if default:
        cells = [f"coalesce({c}, '{default}')" for c in cells]
    return ", ".join(f"{c} as p{p}" for c, p in zip(cells, PERCENTS))


def _run_pivot() -> str:
    columns = []
    for analysis in ("3.1", "3.2", "3.3"):
        here = f"filter (where analysis = '{analysis}')"
        columns += [
            f'max(a) {here} as "A{analysis}_locale"',
            f'max(b) {here} as "A{analysis}_cluster"',
            f'max({SPEEDUP}) {here} as "A{analysis}_speedup"',
        ]
    return f"with {RUNS} select tech, {', '.join(columns)} from firsts where pct = 100 group by tech"


RUN_SUMMARY = (
    f"with {RUNS}, {_run_means('analysis, tech', 'pct = 100')}, "
    f"summary as (select analysis, tech, a, b, {SPEEDUP} as speedup from means)"
)

ORDERS_CHANGED = """
version_a as (select * from orders where o_orderkey % 1777 <> 3),
version_b as (
  select * replace (
    case when o_orderkey % 997 = 7 then 'X' else o_orderstatus end as o_orderstatus,
    case when o_orderkey % 1499 <> 11 then o_orderpriority end as o_orderpriority)
  from orders where o_orderkey % 1999 <> 5
)"""


def _differing_orders() -> str:
    rows = " union all ".join(
        f"select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, cast(1 as bigint) as occurrence, "
        f"'{name}' as column_name, {left} as value_a, {right} as value_b "
        f"from version_a a full outer join version_b b on a.o_orderkey = b.o_orderkey where {where}"
        for name, left, right, where in [
            (
                "(row)",
                "case when a.o_orderkey is null then '0' else '1' end",
                "case when b.o_orderkey is null then '0' else '1' end",
                "a.o_orderkey is null or b.o_orderkey is null",
            )
        ]
        + [
            (
                c,
                f"a.{c}",
                f"b.{c}",
                f"a.o_orderkey is not null and b.o_orderkey is not null "
                f"and a.{c} is distinct from b.{c}",
            )
            for c in ("o_orderstatus", "o_orderpriority")
        ]
    )
    return f"with {ORDERS_CHANGED} {rows}"


ORACLE_SQL: dict[str, str] = {
    "flights_view": f"with {FLIGHTS} select * from flights",
    "raw_view": f"with {RAW} select * from raw",
    "route_month_stats": f"with {FLIGHTS} {_route_month('flights')}",
    "route_month_top10": f"with {FLIGHTS} {_route_month('flights')} "
    "order by codice, aeroporto_partenza, mese limit 10",
    "route_month_zero_mean": f"with {FLIGHTS} {_route_month('flights', '0')}",
    "band_stats": f"with {FLIGHTS} select origin as aeroporto_partenza, month as mese, "
    f"{_band_columns()} from flights group by origin, month",
    "cause_counts": f"with {FLIGHTS},{_cause_rows()} select origin as aeroporto_partenza, "
    "month as mese, causa, frequenza from counted",
    "cause_top3": f"with {FLIGHTS},{_cause_rows()} select origin as aeroporto_partenza, "
    "month as mese, causa, frequenza, cast(rk as int) as ranking from ranked where rk <= 3",
    "cause_top3_window": f"with {FLIGHTS},{_cause_rows()} select origin as aeroporto_partenza, "
    "month as mese, causa, frequenza, cast(rk as int) as ranking from ranked where rk <= 3",
    "delay_band_report": _delay_bands(),
    "delay_band_top10": _delay_bands() + " order by aeroporto_partenza, mese limit 10",
    "delay_band_cancelled_codes": _delay_bands("0", on_cancelled_only=True),
    "airport_means": f"with {FLIGHTS} select origin as aeroporto_partenza, "
    f"{_mean('dep_delay', 'cancelled = 0')} as ritardo_medio_complessivo "
    "from flights group by origin",
    "carrier_deviation": f"with {FLIGHTS},{_carriers()} select * from report",
    "carrier_deviation_top10": f"with {FLIGHTS},{_carriers()} select * from report "
    "order by aeroporto_partenza, classifica limit 10",
    "carrier_deviation_exact": f"with {FLIGHTS},{_carriers('exact')} select * from report",
    "carrier_deviation_nulls_last": f"with {FLIGHTS},{_carriers(nulls='last')} "
    "select * from report",
    "carrier_deviation_zero_mean": f"with {FLIGHTS},"
    f"{_carriers('mixed', '0', drop_airports=True)} select * from report",
    "drop_corrupt": f"with {RAW} select * from raw where not {CORRUPT}",
    "impute_causes": f"with {RAW} select year, diverted, {FLIGHT_COLUMNS}, {IMPUTED} from raw",
    "drop_outliers": f"with {FLIGHTS} select * from flights where not {OUTLIER}",
    "clean_flights": f"with {RAW} select * replace (cast(fl_date as timestamp) as fl_date) from "
    f"(select {FLIGHT_COLUMNS}, {IMPUTED} from raw "
    f"where not {CORRUPT} and not {OUTLIER})",
    "clean_audit": f"""with {RAW},
rows_left as (
  select count(*) as initial, count(*) filter (where not {CORRUPT}) as whole,
         count(*) filter (where not {CORRUPT} and not {OUTLIER}) as inside
  from raw
)
select 1 as step, 'initial' as name, initial as row_count, 17 as column_count from rows_left
union all select 2, 'drop_corrupt', whole, 17 from rows_left
union all select 3, 'drop_year', whole, 16 from rows_left
union all select 4, 'keep_columns', whole, 15 from rows_left
union all select 5, 'drop_outliers', inside, 15 from rows_left""",
    "null_counts": f"with {RAW} {_null_counts('raw', RAW_COLUMNS)}",
    "delay_limits": f"with {RAW} "
    + " union all ".join(
        f"select '{c}' as column_name, min({c}) as smallest, max({c}) as largest from raw"
        for c in ("dep_delay", "arr_delay")
    ),
    "outlier_rate": f"with {RAW} select count(*) as row_count, "
    f"count(*) filter (where {OUTLIER}) as outliers, "
    f"100.0::double * count(*) filter (where {OUTLIER}) / count(*) as outlier_percent from raw",
    "distinct_cancelled": f"with {RAW} select cancelled as value, count(*) as row_count "
    "from raw group by cancelled",
    "distinct_carriers": f"with {RAW} select op_unique_carrier as value, count(*) as row_count "
    "from raw group by op_unique_carrier",
    "uncoded_cancellations": f"with {RAW} "
    + _null_counts("raw", RAW_COLUMNS, "cancellation_code is null and cancelled = 1"),
    "quality_counts": f"with {RAW} select count(*) as row_count, "
    "count(*) filter (where cancelled = 0 and cancellation_code is not null) as code_on_flown, "
    "count(*) filter (where cancelled = 1 and cancellation_code is null) "
    "as cancelled_without_code, "
    "count(*) filter (where cancelled is null or cancelled not in (0, 1)) as unknown_flag "
    "from raw",
    "sample_10": _sample(0.10),
    "sample_25": _sample(0.25),
    "sample_50": _sample(0.50),
    "sample_75": _sample(0.75),
    "sample_100": _sample(1.0),
    "oversample_150": f"select {ORDER_COLUMNS} from orders union all ({_sample(0.5)})",
    "sample_strata_25": f"""with ranked as (
  select *, row_number() over (partition by o_orderpriority
                               order by {ORDER_HASH}) as rn,
         count(*) over (partition by o_orderpriority) as total
  from orders
)
select {ORDER_COLUMNS} from ranked where rn <= round_even(0.25::double * total, 0)""",
    "sample_flights_25": f"with {FLIGHTS},\n{_flight_sample(0.25, 'quarter')} "
    "select * from quarter",
    "sample_identical_25": _identical_sample(),
    "sample_strata_identical_25": _identical_sample("partition by origin"),
    "sample_tied_25": f"""with {FLIGHTS},
hashed as (
  select op_carrier_fl_num, {FEW}, md5('42|' || cast(op_carrier_fl_num as varchar)) as h1,
         {_few_hash("op_carrier_fl_num, " + FEW)} as h2
  from flights
),
placed as (select *, row_number() over (order by h1, h2) as rn, count(*) over () as total
           from hashed)
select op_carrier_fl_num, {FEW} from placed where rn <= round_even(0.25::double * total, 0)""",
    "shuffled_tied": f"""with {FLIGHTS}
select op_carrier_fl_num, {FEW}, row_number() over (
  order by {_few_hash("origin")}, {_few_hash("op_carrier_fl_num, " + FEW)}) - 1 as place
from flights""",
    "shuffled_identical": f"with {FLIGHTS} select {FEW}, "
    f"row_number() over (order by {_few_hash(FEW)}) - 1 as place from flights",
    "shuffled_orders": f"select *, row_number() over (order by {ORDER_HASH}) - 1 as place "
    "from orders",
    "scaled_rows": f"with {_orders_ranked()} "
    + " union all ".join(
        f"select {ORDER_COLUMNS}, {p} as scale from ranked "
        f"where rn <= round_even({p / 100}::double * total, 0)"
        for p in (28, 29, 57)
    )
    + f" union all select {ORDER_COLUMNS}, 150 from ranked union all "
    f"select {ORDER_COLUMNS}, 150 from ranked where rn <= round_even(0.5::double * total, 0)",
    "scaled_counts": f"with {_orders_ranked()} "
    + " union all ".join(
        f"select {p} as scale, count(*) as row_count, cast(sum(o_orderkey) as bigint) as key_sum "
        f"from ranked where rn <= round_even({p / 100}::double * total, 0)"
        for p in (10, 25, 50, 75, 100)
    )
    + " union all select 150, cast(sum(n) as bigint), cast(sum(k) as bigint) from ("
    "select count(*) as n, sum(o_orderkey) as k from ranked union all "
    "select count(*), sum(o_orderkey) from ranked where rn <= round_even(0.5::double * total, 0))",
    "reconcile_reports": f"{FULL_AND_HALF},{_summary('3.1', ROUTE_MEASURES, 0.01)}",
    "reconcile_precision": f"{ROUNDED_AND_EXACT},{_summary('3.3', CARRIER_MEASURES, 0.0)}",
    "reconcile_stored": f"select * from ({ROUNDED_AND_EXACT},"
    f"{_summary('3.3 stored', CARRIER_MEASURES, 0.01, per_column=False)}) union all "
    "select '3.3 missing', null, null, null, null, null, null, null, 'missing input'",
    "differing_cells": f"{ROUNDED_AND_EXACT} {_cell_rows(CARRIER_KEY, CARRIER_MEASURES, 0.0)}",
    "side_by_side": f"{FULL_AND_HALF} select {', '.join(ROUTE_KEY)}, "
    "in_a is not null as in_locale, in_b is not null as in_cluster, "
    + ", ".join(f"{m}_a as {m}_locale, {m}_b as {m}_cluster" for m in ROUTE_MEASURES)
    + f" from pairs order by {', '.join(ROUTE_KEY)} limit 10",
    "set_difference": f"""with {FLIGHTS},
inside as (select * from flights where not {OUTLIER}),
version_a as ({_route_month("flights")}),
version_b as ({_route_month("inside")})
select *, cast(1 as bigint) as rows_a, cast(0 as bigint) as rows_b
from (select * from version_a except select * from version_b)
union all
select *, cast(0 as bigint), cast(1 as bigint)
from (select * from version_b except select * from version_a)""",
    "multiset_difference": f"""with {FLIGHTS},
cells as (select op_unique_carrier, origin, month, dep_delay, 1 as in_a,
                 case when coalesce(dep_delay < -30 or dep_delay > 110, false) then 0 else 1 end
                   as in_b
          from flights)
select op_unique_carrier, origin, month, dep_delay, cast(sum(in_a) as bigint) as rows_a,
       cast(sum(in_b) as bigint) as rows_b
from cells group by op_unique_carrier, origin, month, dep_delay
having sum(in_a) <> sum(in_b)""",
    "differing_orders": _differing_orders(),
    "set_difference_orders": f"""with {ORDERS_CHANGED}
select *, cast(1 as bigint) as rows_a, cast(0 as bigint) as rows_b
from (select * from version_a except select * from version_b)
union all
select *, cast(0 as bigint), cast(1 as bigint)
from (select * from version_b except select * from version_a)""",
    "route_month_scales": _at_scales(lambda flights: f"with {flights} {_route_month('flights')}"),
    "delay_band_scales": _at_scales(lambda flights: _delay_bands(flights=flights)),
    "carrier_deviation_scales": _at_scales(
        lambda flights: f"with {flights}, {_carriers()} select * from report"
    ),
    "run_pivot": _run_pivot(),
    "run_cells": f"with {RUNS} select analysis, tech, pct, analysis || ' / ' || tech as label, a, b, "
    f"{SPEEDUP} as speedup, case when a - b - 20 > 0 then 'yes' when a - b - 20 <= 0 then 'no' "
    "else '-' end as saves from firsts",
    "run_speedup": f"with {RUNS} select analysis, tech, pct, analysis || ' / ' || tech as label, "
    f"a, b, {SPEEDUP} as speedup from firsts where a is not null and b is not null",
    "run_speedup_matrix": f"with {RUNS} select analysis || ' / ' || tech as label, "
    f"{_by_percent(SPEEDUP)} from firsts where a is not null and b is not null group by label",
    "run_seconds_matrix": f"with {RUNS} select analysis || ' / ' || tech as label, "
    f"{_by_percent('a')} from firsts where a is not null group by label",
    "run_mean_speedup": f"with {RUNS}, {_run_means('tech, pct')} "
    f"select tech, pct, {SPEEDUP} as speedup from means where a is not null and b > 0",
    "run_break_even": f"""with {RUNS},
grid as (select distinct tech, unnest(['3.1', '3.2', '3.3']) as analysis from runs),
flags as (select tech, analysis, pct,
                 case when a - b - 20 > 0 then 'yes' when a - b - 20 <= 0 then 'no' end as flag
          from firsts)
select tech, analysis, {_by_percent('flag', '-')}
from grid left join flags using (tech, analysis) group by tech, analysis""",
    "run_summary": f"{RUN_SUMMARY} select * from summary",
    "run_extremes": f"""{RUN_SUMMARY},
known as (select *, analysis || ' / ' || tech as label from summary where speedup is not null)
select max(speedup) as best_speedup,
       first(label order by speedup desc, analysis, tech) as best_run,
       min(speedup) as worst_speedup,
       first(label order by speedup, analysis, tech) as worst_run,
       {_half_up("cast(sum(cast(speedup as decimal(10,2))) as double) / count(*)")}
         as mean_speedup
from known""",
    "csv_roundtrip": f"with {FLIGHTS} select * from flights",
    "parquet_roundtrip": f"with {FLIGHTS} select * from flights",
    "csv_rejects": f"""with {RAW},
marked as (
  select *, cast(op_carrier_fl_num as bigint) % 71 = 3 as short,
         cast(op_carrier_fl_num as bigint) % 73 = 1 as late,
         cast(op_carrier_fl_num as bigint) % 79 = 2 as two
  from raw
),
told as (
  select *, concat_ws('+', case when short then 'width' end, case when late then 'dep_delay' end,
                      case when two or cancelled = 2 or (cancelled is null and not short)
                           then 'flag' end) as reasons
  from marked
)
select {', '.join(f"case when reasons = '' then {c} end as {c}" for c in
                  ("op_carrier_fl_num", "origin", "dep_delay", "arr_delay", "cancelled"))},
       case when reasons = '' then cast(fl_date as timestamp) end as fl_date, reasons,
       case when reasons <> '' then concat_ws(',', {', '.join(map(_raw_text, RAW_COLUMNS[:-3]))})
         || case when short then '' else ',' || concat_ws(',', {', '.join(map(_raw_text, RAW_COLUMNS[-3:]))}) end
       end as record
from told""",
    "declared_table": f"with {FLIGHTS} select origin, cancelled, count(*) as row_count, "
    "sum(dep_delay) as dep_sum from flights group by origin, cancelled",
    "report_roundtrip": _delay_bands(),
    "report_snapshot": f"with {FLIGHTS},{_carriers()} select * from report "
    "order by aeroporto_partenza, classifica limit 10",
    "scales_roundtrip": f"with {_orders_ranked()}, members as ("
    + " union all ".join(
        f"select {ORDER_COLUMNS}, {p} as scale from ranked "
        f"where rn <= round_even({p / 100}::double * total, 0)"
        for p in (10, 25, 50, 75, 100)
    )
    + f" union all select {ORDER_COLUMNS}, 150 from ranked"
    f" union all select {ORDER_COLUMNS}, 150 from ranked "
    "where rn <= round_even(0.5::double * total, 0)) "
    "select * from members cross join (values ('parquet'), ('csv')) f(format)",
    "reconcile_repeated": _repeated_summary(),
    "differing_repeated": _repeated_cells(),
    "run_log": f"with {RUNS} select analysis, tech, pct, env, cast(seconds as double) as seconds, "
    "event_id as repeat from runs",
    "carrier_deviation_by_carrier": f"with {FLIGHTS},{_carriers()} select * from report "
    "order by aeroporto_partenza, compagnia limit 10",
    "carrier_order": f"with {FLIGHTS},{_carriers()} select *, row_number() over ("
    "order by aeroporto_partenza, compagnia) as place from report",
    "differing_paired": _paired_cells(),
    "preparation_profile": f"with {RAW} "
    + " union all ".join(
        f"select '{name}' as measure, '{c}' as column_name, "
        f"cast(count(*) filter (where {c} is null{more}) as double) as value from raw"
        for name, more in (
            ("nulls", ""),
            ("nulls_uncoded", " and cancellation_code is null and cancelled = 1"),
        )
        for c in RAW_COLUMNS
    )
    + "".join(
        f" union all select '{name}', '{c}', {f}({c}) from raw"
        for name, f in (("smallest", "min"), ("largest", "max"))
        for c in ("dep_delay", "arr_delay")
    )
    + f""" union all select 'rows', '', cast(count(*) as double) from raw
union all select 'outliers', '', cast(count(*) filter (where {OUTLIER}) as double) from raw
union all select 'outlier_percent', '',
  100.0::double * count(*) filter (where {OUTLIER}) / count(*) from raw
union all select 'flags', coalesce(cast(cancelled as varchar), 'missing'),
  cast(count(*) as double) from raw group by cancelled""",
}
