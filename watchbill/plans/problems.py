"""The pN_ queries of the core: packed fields, snapshots, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchbill.functions.clock import minute_text, shift_span
from watchbill.operators.intervals import cover
from watchbill.operators.multivalue import explode_values
from watchbill.operators.snapshots import instant, json_text, snapshot_changes, with_values
from watchbill.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of the fields of entry and imaging that hold two or more."""
    parts = []
    for src, key, fields in (("entry", "entry_id", ["name"]), ("imaging", "imaging_id", ["consultant", "residents"])):
        rows = table(spark, sf_dir, src).withColumnRenamed(key, "row_id")
        parts.append(explode_values(rows, ["row_id"], fields).select(F.lit(src).alias("src"), "row_id", "field", "pos", "val"))
    return parts[0].unionByName(parts[1])


def _snapshot_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "rota_snapshot")
    at = F.coalesce(instant(F.col("created_at")).cast("string"), F.trim("created_at"))  # unreadable instants as typed
    state = [F.lower(F.trim("specialty")), at, json_text(F.col("data"))]
    return rows, snapshot_changes(rows, "snap_no", ["record_id"], state, "delivered_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records added, removed or changed from each snapshot of rota_snapshot to the next."""
    return _snapshot_changes(spark, sf_dir)[1]


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the values before and after."""
    rows, changes = _snapshot_changes(spark, sf_dir)
    return with_values(changes, rows, "snap_no", ["record_id"], ["specialty", "created_at", "data"], "delivered_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of cover and the gaps between them per upload and role of entry."""
    role = F.lower(F.trim(F.regexp_replace("role", "[\\s\u00a0]+", " ")))
    span = shift_span(F.col("duty_date"), F.col("starttime"), F.col("endtime"))
    # one generated row, so that filters on what is read do not read it again
    rows = table(spark, sf_dir, "entry").where("duty_date is not null").select("upload_id", F.inline(F.array(F.struct(role.alias("role"), span.alias("at")))))
    out = cover(rows.where("role <> ''"), ["upload_id", "role"], F.col("at.a"), F.col("at.b"))
    return out.select("upload_id", "role", "kind", *[minute_text(F.col(c)).alias(c) for c in ("from_at", "to_at")])


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_values": p2_values, "p3_found": p3_found}

_MINUTE = r"""case
  when regexp_full_match({t}, '([01]?[0-9]|2[0-3])[:.h][0-5][0-9](:[0-5][0-9])?') then cast(split_part(replace(replace({t}, '.', ':'), 'h', ':'), ':', 1) as int) * 60 + cast(split_part(replace(replace({t}, '.', ':'), 'h', ':'), ':', 2) as int)
  when regexp_full_match({t}, '([01][0-9]|2[0-3])[0-5][0-9]') then cast({t}[1:2] as int) * 60 + cast({t}[3:4] as int)
  when regexp_full_match({t}, '24[:.h]?00(:00)?') then 1440
  when regexp_full_match({t}, '(0?[1-9]|1[0-2]):[0-5][0-9] ?[ap]m') then cast(split_part({t}, ':', 1) as int) % 12 * 60 + cast(substr(split_part({t}, ':', 2), 1, 2) as int) + case when {t} like '%pm' then 720 else 0 end
end"""

# A JSON object as its sorted keys with the type and the unescaped value of each, hours one level deeper.
_FLAT = "array_to_string(list_transform(list_sort(json_keys({o})), lambda k: k || '=' || json_type({o}, '$.' || k) || ':' || coalesce({v}, '')), ',')"
_INNER = _FLAT.format(o="(e->'$.hours')", v="(e->'$.hours')->>('$.' || k)").replace("lambda k", "lambda h").replace("|| k", "|| h").replace(": k ||", ": h ||")
_ENTRY = _FLAT.format(o="e", v=f"case when k = 'hours' and json_type(e, '$.hours') = 'OBJECT' then {_INNER} else e->>('$.' || k) end")
_DATA = _FLAT.format(o="data", v=f"case when k = 'entries' and json_type(data, '$.entries') = 'ARRAY' then array_to_string(list_transform(cast(data->'$.entries' as json[]), lambda e: {_ENTRY}), ';') else data->>('$.' || k) end")

ORACLE = {
    "p2_found": f"""
with r as (
  select snap_no, record_id, delivered_at, lower(trim(specialty)) as s,
    epoch_us(cast(regexp_replace(regexp_replace(created_at, 'T', ' '), '([+-][0-9]{{2}})$', '\\1:00') as timestamptz)) as at, {_DATA} as d, data is null as empty
  from rota_snapshot),
one as (select * from (select *, row_number() over (partition by snap_no, record_id order by delivered_at desc) as n from r) where n = 1),
steps as (select snap_no, lag(snap_no) over (order by snap_no) as prior from (select distinct snap_no from r)),
a as (select s.snap_no, o.record_id, o.s, o.at, o.d, o.empty from steps s join one o on o.snap_no = s.prior),
b as (select o.* from one o join steps s on o.snap_no = s.snap_no where s.prior is not null)
select coalesce(a.snap_no, b.snap_no) as snap_no, coalesce(a.record_id, b.record_id) as record_id,
  case when a.record_id is null then 'added' when b.record_id is null then 'removed' else 'changed' end as change
from a full join b on a.snap_no = b.snap_no and a.record_id = b.record_id
where a.record_id is null or b.record_id is null or a.s is distinct from b.s or a.at is distinct from b.at or a.d is distinct from b.d or a.empty <> b.empty
""",
    "p3_found": f"""
with typed as (
  select upload_id, lower(trim(regexp_replace(role, '\\s+', ' ', 'g'))) as role, duty_date,
    lower(trim(translate(starttime, '٠١٢٣٤٥٦٧٨٩', '0123456789'))) as s, lower(trim(translate(endtime, '٠١٢٣٤٥٦٧٨٩', '0123456789'))) as e
  from entry where duty_date is not null),
minutes as (
  select upload_id, role, duty_date, {_MINUTE.format(t='s')} as a, {_MINUTE.format(t='e')} as b from typed where role <> ''),
shifts as (
  select upload_id, role, duty_date::timestamp + to_minutes(a) as s, duty_date::timestamp + to_minutes(case when b > a then b else b + 1440 end) as e
  from minutes where a is not null and b is not null),
reach as (
  select *, max(e) over (partition by upload_id, role order by s, e rows between unbounded preceding and 1 preceding) as reached from shifts),
numbered as (
  select *, sum(case when reached is null or s > reached then 1 else 0 end) over (partition by upload_id, role order by s, e rows unbounded preceding) as n from reach),
periods as (select upload_id, role, n, min(s) as s, max(e) as e from numbered group by all),
gaps as (select upload_id, role, lag(e) over (partition by upload_id, role order by n) as s, s as e from periods)
select upload_id, role, 'period' as kind, strftime(s, '%Y-%m-%d %H:%M') as from_at, strftime(e, '%Y-%m-%d %H:%M') as to_at from periods
union all
select upload_id, role, 'gap', strftime(s, '%Y-%m-%d %H:%M'), strftime(e, '%Y-%m-%d %H:%M') from gaps where s is not null
""",
}

_VALUES = "select * from (select *, row_number() over (partition by snap_no, record_id order by delivered_at desc nulls last, specialty desc nulls last, created_at desc nulls last, data desc nulls last) as n from rota_snapshot) where n = 1"
ORACLE["p2_values"] = f"""
with f as ({ORACLE["p2_found"]}), t as (select snap_no, lag(snap_no) over (order by snap_no) as prior from (select distinct snap_no from rota_snapshot where snap_no is not null)), v as ({_VALUES})
select f.snap_no, f.record_id, change, o.specialty as old_specialty, w.specialty as new_specialty, o.created_at as old_created_at, w.created_at as new_created_at, o.data as old_data, w.data as new_data
from f join t on f.snap_no = t.snap_no left join v o on o.snap_no = t.prior and o.record_id = f.record_id left join v w on w.snap_no = f.snap_no and w.record_id = f.record_id
"""
