"""More queries of the roster operators: shifts, people, cells, records and audits, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchbill.functions import timeops as T
from watchbill.functions.clock import clock_minute
from watchbill.functions.rules import rule_join
from watchbill.functions.text import canonical_name, clean_phone, date_key, slug
from watchbill.operators import analytics as A
from watchbill.operators import matching as M
from watchbill.operators import people as P
from watchbill.operators import quality as Q
from watchbill.operators import records as X
from watchbill.operators import rows as W
from watchbill.operators import shifts as S
from watchbill.operators import store as K
from watchbill.operators.multivalue import values_of
from watchbill.operators.snapshots import consecutive
from watchbill.plans.reference import _MINUTES, _ROLE, _STEPS, canon, phone
from watchbill.sources.tables import shared_dir, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Shifts.

_RT = "lower(coalesce(role, '') || ' ' || coalesce(section, '') || ' ' || coalesce(coverage_type, '') || ' ' || coalesce(shift_type, ''))"
_DAY = "'\\b(day|duty|coverage|er/consult|inpatient|outpatient|clinic)\\b'"
_WINDOW = f"""w0 as (select *, {_RT} as rt, nullif(trim(shift_type), '') as k from ({_MINUTES})),
w as (select *, case when a is not null and b is not null then a when k in ('24h', 'day') then 450 when k in ('night', 'on-call') then 990 when contains(rt, '24h') then 450 when regexp_matches(rt, {_DAY}) and not contains(rt, 'after') then 450 when regexp_matches(rt, 'on-call|oncall|after|night') then 990 end as ws,
  case when a is not null and b is not null then b when k = '24h' then 450 when k = 'day' then 990 when k in ('night', 'on-call') then 450 when contains(rt, '24h') then 450 when regexp_matches(rt, {_DAY}) and not contains(rt, 'after') then 990 when regexp_matches(rt, 'on-call|oncall|after|night') then 450 end as we,
  case when a is not null and b is not null then coalesce(k, case when a = b then '24h' when a >= 420 and b <= 1020 and b > a then 'day' else 'night' end) when k = '24h' then '24h' when k = 'day' then 'day' when k in ('night', 'on-call') then 'night' when contains(rt, '24h') then '24h' when regexp_matches(rt, {_DAY}) and not contains(rt, 'after') then 'day' when regexp_matches(rt, 'on-call|oncall|after|night') then 'night' end as wk from w0)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    role = S.role_text(*[F.col(c) for c in ("role", "section", "coverage_type", "shift_type")])
    e = table(spark, d, "entry").withColumn("rt", role)
    return e.withColumn("w", S.infer_window(F.col("starttime"), F.col("endtime"), F.col("shift_type"), F.col("rt")))


@query(f"""with {_WINDOW} select ws as start_min, we as end_min, wk as kind, coalesce(lpad(cast(ws // 60 as varchar), 2, '0') || ':' || lpad(cast(ws % 60 as varchar), 2, '0') || '-' || lpad(cast(we // 60 as varchar), 2, '0') || ':' || lpad(cast(we % 60 as varchar), 2, '0'), k, '') as label, count(*) as n from w group by all""")
def shift_windows(spark, d):
    """Shift windows typed or inferred, with what is shown as their time."""
    label = S.time_label(F.col("w"), F.lit(None).cast("string"), F.col("shift_type"))
    return _windows(spark, d).groupBy(F.col("w.start").alias("start_min"), F.col("w.end").alias("end_min"), F.col("w.kind").alias("kind"), label.alias("label")).agg(F.count("*").alias("n"))


@query(f"""with {_WINDOW}, f as (select *, dayofweek(duty_date) in (5, 6) as we_, lower(coalesce(role, '') || ' ' || coalesce(name, '')) like '%no coverage%' as s0,
  coalesce(case when ws is null then null when wk = '24h' then true when we > ws then 1200 >= ws and 1200 < we else 1200 >= ws or 1200 < we end, false) as s1,
  regexp_matches(rt, 'on-call|oncall|on duty|on-duty|senior resident|after|night|24h|weekend') as s2, contains(rt, 'consultant') as s3 from w where duty_date is not null and upload_id is not null and not contains(rt, 'note')),
g as (select *, bool_or(s0) over p as a0, bool_or(s1) over p as a1, bool_and(ws is not null) over p as k_, bool_or(s2) over p as a2, bool_or(s3) over p as a3 from f window p as (partition by upload_id, duty_date))
select entry_id from g where case when a0 then s0 when a1 then s1 when k_ then false when a2 then s2 when a3 then s3 else false end""")
def entries_in_force(spark, d):
    """Entries in force at 20:00 of their day: no coverage, windows, then words of their roles."""
    e = _windows(spark, d).where("duty_date is not null and upload_id is not null")
    return S.in_force(e, ["upload_id", "duty_date"], 1200, T.is_weekend(F.col("duty_date")), "w", "rt", "name").select("entry_id")


@query(f"""with {_WINDOW}, f as (select specialty, case when a is not null and b is not null then (case when b > a then 480 >= a and 480 < b else 480 >= a or 480 < b end) when k = '24h' then true when k = 'day' then dayofweek(duty_date) not in (5, 6) when k in ('night', 'on-call') then dayofweek(duty_date) in (5, 6)
  when (regexp_matches(rt, {_DAY}) or regexp_matches(rt, '07:30|16:30')) and not contains(rt, 'after') then dayofweek(duty_date) not in (5, 6) when regexp_matches(rt, 'on-call|oncall|on duty|on-duty|senior resident|after|night|24h|weekend') then dayofweek(duty_date) in (5, 6) else false end as on_ from w where duty_date is not null)
select specialty, count(*) as n, count(*) filter (on_) as active from f group by 1""")
def rows_active(spark, d):
    """Rows that hold at 08:00 of their day, each by itself."""
    e = _windows(spark, d).where("duty_date is not null")
    a, b = clock_minute(F.col("starttime")), clock_minute(F.col("endtime"))
    typed = F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))
    on = S.entry_active(typed, F.nullif(F.trim("shift_type"), F.lit("")), F.col("rt"), F.lit(480), T.is_weekend(F.col("duty_date")))
    return e.groupBy("specialty").agg(F.count("*").alias("n"), F.count_if(on).alias("active"))


@query("""with e as (select event_type, hour(ts) * 60 + minute(ts) as m, dayofweek(ts) in (5, 6) as we from events),
r as (select * from (values ('click', true, 450, 450), ('click', false, 990, 450), ('view', false, 450, 990), ('error', true, 600, 720)) t(event_type, we, s, e))
select event_type, count(*) as n, count(*) filter (coalesce(case when r.e > s then m >= s and m < r.e else m >= s or m < r.e end, false)) as active from e left join r using (event_type, we) group by 1""")
def calendar_rules(spark, d):
    """Events while the calendar's window of their type holds, weekends apart."""
    rules = spark.createDataFrame([("click", True, 450, 450), ("click", False, 990, 450), ("view", False, 450, 990), ("error", True, 600, 720)], "key string, weekend boolean, start int, end int")
    e = S.calendar_active(table(spark, d, "events"), "event_type", T.minute_of_day(F.col("ts")), T.is_weekend(F.to_date("ts")), rules)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("active").alias("active"))


@query("""with m as (select hour(ts) * 60 + minute(ts) as m from events)
select case when m >= 930 and m < 990 then 'duty:current,on-call:upcoming' when m >= 450 and m < 990 then 'duty:current' when m >= 390 and m < 450 then 'on-call:current,duty:upcoming' else 'on-call:current' end as windows, count(*) as n from m group by 1""")
def shift_lookahead(spark, d):
    """Events by the shift windows that hold then, and those that start within the hour."""
    w = S.upcoming(T.minute_of_day(F.col("ts")), [("duty", 450, 990), ("on-call", 990, 450)])
    label = F.array_join(F.transform(w, lambda x: F.concat(x["name"], F.lit(":"), x["state"])), ",")
    return table(spark, d, "events").groupBy(label.alias("windows")).agg(F.count("*").alias("n"))


@query("""with p as (select site_code, section, upper(day_name[1:1]) || lower(day_name[2:3]) as day, unnest(string_split(consultant, '/')) as person, generate_subscripts(string_split(consultant, '/'), 1) as i, imaging_id from imaging),
f as (select site_code, section, day, imaging_id, trim(person) as person, min(i) as i from p group by all)
select site_code, section, day, person, row_number() over (partition by imaging_id, site_code, section, day order by i) as pos from f""")
def weekday_roster(spark, d):
    """The consultants of each section by weekday, one row each."""
    i = table(spark, d, "imaging")
    people = F.transform(F.split("consultant", "/"), lambda p: F.trim(p))
    return S.roster_of_day(i.withColumnRenamed("day_name", "dn"), ["site_code", "section"], "dn", people).select("site_code", "section", "day", "person", "pos")


@query("""with r as (select entry_id, upload_id, date_key = '12/03' as hit from entry where date_key is null or trim(date_key) = '' or date_key = '12/03'), g as (select *, bool_or(coalesce(hit, false)) over (partition by upload_id) as any_ from r)
select entry_id from g where coalesce(hit, false) or not any_""")
def undated_fallback(spark, d):
    """Entries of a date, or the undated ones of uploads that lack it."""
    return S.dated_or_undated(table(spark, d, "entry").select("entry_id", "upload_id", "date_key"), ["upload_id"], "date_key", F.lit("12/03")).select("entry_id")


@query("""with n as (select max(ts) as now from events), e as (select floor(epoch(now) - 0)::bigint - floor(epoch(ts))::bigint as s, hour(ts) * 60 + minute(ts) as m from events, n)
select case when s < 60 then 'just now' when s < 3600 then (s // 60) || ' min ago' when s < 86400 then (s // 3600) || ' h ago' else (s // 86400) || ' d ago' end as ago, case when m >= 990 and m < 1260 then 990 when m >= 1260 or m < 450 then 1260 else 450 end as slot, count(*) as n from e group by all""")
def ago_labels(spark, d):
    """Events by how long ago they were, and by the slot of the day."""
    e = table(spark, d, "events")
    both = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    return both.groupBy(S.ago(F.col("now"), F.col("ts")).alias("ago"), S.slot_start(T.minute_of_day(F.col("ts"))).alias("slot")).agg(F.count("*").alias("n"))


@query("""with now as (select month(max(duty_date)) as m from entry), k as (select upload_id, try_cast(split_part(date_key, '/', 2) as int) as m from entry where upload_id is not null)
select upload_id, array_to_string(list_sort(list(distinct k.m) filter (k.m is not null)), ',') as months, count(k.m) > 0 and not coalesce(bool_or(k.m = now.m), false) as stale from k, now group by upload_id""")
def stale_months(spark, d):
    """Months named by the days of each upload, and whether the newest month is missing."""
    e = table(spark, d, "entry").where("upload_id is not null")
    both = e.withColumn("m", F.try_element_at(F.split("date_key", "/"), F.lit(2)).try_cast("int")).crossJoin(F.broadcast(table(spark, d, "entry").agg(F.month(F.max("duty_date")).alias("now"))))
    out = X.month_stale(both, ["upload_id", "now"], F.col("m"), F.col("now"))
    return out.select("upload_id", F.array_join(F.transform("months", lambda m: m.cast("string")), ",").alias("months"), "stale")


@query(f"""with m as ({_MINUTES}), f as (select specialty, dayofweek(duty_date) in (5, 6) as we, shift_type as k, a, b from m where duty_date is not null)
select specialty, count(*) filter (case when k = '24h' then true when a is not null and b is not null then (case when b > a then 600 >= a and 600 < b else 600 >= a or 600 < b end) when k = 'day' then not we when k in ('night', 'on-call') then we end) as active from f group by 1""")
def windows_at_ten(spark, d):
    """Rows whose shift window holds at 10:00 of their day."""
    e = table(spark, d, "entry").where("duty_date is not null")
    at = (F.col("duty_date").cast("timestamp_ntz") + F.expr("INTERVAL '10' HOUR"))
    on = T.window_active(at, clock_minute(F.col("starttime")), clock_minute(F.col("endtime")), F.col("shift_type"))
    return e.groupBy("specialty").agg(F.count_if(F.coalesce(on, F.lit(False))).alias("active"))


# People.

_NEVER = ", ".join(f"'{w}'" for w in P.NEVER)
_PERSON = f"""(length(trim({{x}})) between 3 and 80 and lower(trim({{x}})) not in ({_NEVER}) and regexp_matches({{x}}, '[a-zA-Z؀-ۿ]') and not regexp_matches(trim({{x}}), '^[A-Z\\s]{{{{20,}}}}$') and not regexp_matches(trim({{x}}), '^[\\d\\s/-]+$') and not regexp_matches(trim({{x}}), '^(?i:sun|mon|tue|wed|thu|fri|sat)(?i:day)?$') and not regexp_matches(trim({{x}}), '^(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)$') and not regexp_matches(trim({{x}}), '^(?i:1st|2nd|3rd|4th|5th)\\s*(?i:on|call|duty)'))"""
# titles as whole words, of letters of any script
_TITLES = "len(list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w = 'dr'))"
_CLEAN = """trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '\\b(?i:dr)\\.([A-Za-z])', 'Dr. \\1', 'g'), '^(?i:dr)\\.?\\s+(?i:dr)\\.?\\s*', 'Dr. '), '^(?i:mon|tue|wed|thu|fri|sat|sun)\\w*\\s+', ''))"""


@query(f"""with a as (select entry_id, phone, role, date_key, list_filter(list_transform(string_split(regexp_replace(trim(name), '\\b(Dr\\.\\w)', chr(1) || '\\1', 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '') as ps from entry where name is not null),
b as (select entry_id, phone, role, date_key, flatten(list_transform(ps, lambda p: case when contains(p, ',') and len(list_filter(list_transform(string_split(p, ','), lambda x: trim(x)), lambda x: length(x) >= 2)) > 1 then list_filter(list_transform(string_split(p, ','), lambda x: trim(x)), lambda x: length(x) >= 2) else [p] end)) as ps from a),
c as (select entry_id, phone, coalesce(role, '') as r, coalesce(date_key, '') as dk, generate_subscripts(ps, 1) - 1 as part, unnest(ps) as raw from b),
d as (select *, {_CLEAN.format(x='raw')} as name from c),
e as (select *, string_split(name, ' ') as ws from d where length(name) >= 2 and not regexp_matches(name, '(?i)\\b(?:pdf|obj|endobj|stream|endstream|xref|trailer|startxref|eof)\\b') and {_TITLES.format(x='name')} <= 1),
f as (select * from e where not (len(list_filter(ws, lambda w: not (w = upper(w) and length(w) <= 3))) = 0 and length(name) <= 4) and (coalesce(phone, '') <> '' or regexp_matches(name, '[a-z]') or (len(list_filter(ws, lambda w: length(w) < 4)) = 0 and len(list_filter(ws, lambda w: length(w) >= 5)) > 0)) and {_PERSON.format(x='name')})
select entry_id, part, name from (select *, row_number() over (partition by lower(trim(name)), r, dk order by entry_id, part) as n from f) where n <= 3""")
def normalized_people(spark, d):
    """Entries with names split and cleaned, rows that hold no person left out, repeats capped."""
    return P.normalize_people(table(spark, d, "entry"), "entry_id", "name", "phone", "role", "date_key").select("entry_id", "part", "name")


@query(f"""with a as (select site_code, contact_id, {phone('phone')} as p, {_CLEAN.format(x='name')} as t from contact where {phone('phone')} is not null and name is not null and {_PERSON.format(x='name')}),
b as (select *, regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g') as s, trim(regexp_replace(t, '^(?i:dr)\\.?\\s*', '')) as bare from a),
c as (select *, trim(regexp_replace(s, '^(?i:dr)\\.?\\s*', '')) as sbare, string_split(bare, ' ') as ws from b),
k as (select site_code, contact_id, p, unnest([t, case when s <> t then s end, case when s <> t then sbare end, bare, case when len(ws) >= 2 and length(ws[-1]) >= 5 then ws[-1] end, case when len(ws) >= 3 and lower(ws[-2]) = 'al' then ws[-2] || ' ' || ws[-1] end]) as key, unnest(['full', 'split', 'split', 'bare', 'last', 'al']) as kind, unnest([0, 1, 2, 3, 4, 5]) as pos from c)
select site_code, key, kind, p as phone from (select *, row_number() over (partition by site_code, key order by contact_id, pos, p) as n from k where key <> '') where n = 1""")
def contact_variants(spark, d):
    """Keys of the contacts of each site, the first contact winning."""
    c = table(spark, d, "contact").where("name is not null").withColumn("p", clean_phone(F.col("phone")))
    return P.contact_keys(c, ["site_code"], "name", "p", "contact_id")


@query()
def scored_match(spark, d):
    """The contact of its site whose name an entry's name scores highest with; contacts of a rank count more."""
    c = table(spark, d, "contact").select("contact_id", "site_code", F.col("name").alias("n"), "rank", "phone")
    boosts = [(F.col("phone").isNotNull(), 1), (F.col("rank").isNotNull(), 2)]
    e = table(spark, d, "entry").where(F.size(values_of(F.col("name"))) == 1)  # fields of several people name no one person
    return P.scored_match(e, "entry_id", "name", ["site_code"], c, "contact_id", "n", 2, boosts)


_NORM = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""with a as (select distinct doctor, {_NORM.format(x='doctor')} as a from rota_edit where {_NORM.format(x='doctor')} <> ''), b as (select contact_id, {_NORM.format(x='name')} as b from contact where {_NORM.format(x='name')} <> ''),
m as (select doctor, min(contact_id) as contact_id from a join b on a.a = b.b or ends_with(a.a, ' ' || b.b) or ends_with(b.b, ' ' || a.a) group by 1)
select edit_id, m.contact_id from rota_edit e left join m on e.doctor = m.doctor""")
def suffix_join(spark, d):
    """Edits with the first contact whose name is the edit's name or a tail of it, or the other way round."""
    c = table(spark, d, "contact").select(F.col("name").alias("n"), "contact_id", F.col("contact_id").alias("ord"))
    return X.by_suffix(table(spark, d, "rota_edit").select("edit_id", "doctor"), "doctor", c, "n", "contact_id", "ord").select("edit_id", "contact_id")


@query(f"""with c as (select site_code, contact_id, name, {phone('phone')} as p from contact where {phone('phone')} is not null and name is not null),
t as (select site_code, p, name as full_name from (select *, row_number() over (partition by site_code, p order by length(name) desc, contact_id) as n from c where lower(name) like 'dr%') where n = 1)
select site_code, alias, full_name from (select c.site_code, c.name as alias, t.full_name, row_number() over (partition by c.site_code, c.name order by contact_id desc) as n from c join t on c.site_code = t.site_code and c.p = t.p where c.name <> t.full_name) where n = 1""")
def phone_aliases(spark, d):
    """Names that lead to the titled name of their phone."""
    return X.aliases(table(spark, d, "contact").withColumn("p", clean_phone(F.col("phone"))), ["site_code"], "name", "p", "contact_id")


@query("""with t as (select distinct trim(regexp_replace(regexp_replace(lower(section), '[^a-z0-9؀-ۿ\\s-]', '', 'g'), '\\s+', ' ', 'g')) as t from imaging where section is not null union select distinct trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9؀-ۿ\\s-]', '', 'g'), '\\s+', ' ', 'g')) from specialty where label is not null),
c as (select specialty, replace(lower(specialty), '_', ' ') as sp, lower(label) as l, list_transform(coalesce(keywords, []), lambda k: lower(k)) as ks from specialty),
m as (select t, specialty, case when t = sp or t = l then 3 when list_contains(ks, t) then 2 when len(f) > 0 then 1 end as level, len(string_split(f[1], ' ')) as n from (select t, specialty, sp, l, ks, list_filter(list_prepend(sp, ks), lambda a: len(list_filter(string_split(t, ' '), lambda q: len(list_filter(string_split(a, ' '), lambda w: contains(w, q) or contains(q, w))) = 0)) = 0) as f from t, c where t <> '')),
s as (select t, level, case when level = 1 then n else 0 end as n, min(specialty) as specialty, count(*) as hits from m where level is not null group by 1, 2, 3),
b as (select * from (select *, row_number() over (partition by t order by level desc, n desc) as r from s) where r = 1)
select t.t, b.specialty, case when b.t is null then 'new' when level = 3 then 'exact' when level = 2 then 'alias' when hits > 1 then 'ambiguous' else 'fuzzy' end as how from t left join b on t.t = b.t where t.t <> ''""")
def specialty_match(spark, d):
    """Typed sections and labels matched to the catalogue of specialties: exact, alias, fuzzy, ambiguous or new."""
    typed = table(spark, d, "imaging").select(F.col("section").alias("x")).unionByName(table(spark, d, "specialty").select(F.col("label").alias("x")))
    typed = typed.select(F.trim(F.regexp_replace(F.regexp_replace(F.lower("x"), "[^a-z0-9؀-ۿ\\s-]", ""), "\\s+", " ")).alias("t")).distinct()
    return X.match_alias(typed, "t", "t", table(spark, d, "specialty").withColumnRenamed("specialty", "s"), "s", "label", "keywords").withColumnRenamed("s", "specialty")


@query("""with c as (select imaging_id, trim(u) as consultant, i as pos from (select imaging_id, unnest(string_split(consultant, '/')) as u, generate_subscripts(string_split(consultant, '/'), 1) - 1 as i from imaging where consultant is not null)),
r as (select imaging_id, trim(u) as resident, i as pos from (select imaging_id, unnest(string_split(residents, '/')) as u, generate_subscripts(string_split(residents, '/'), 1) - 1 as i from imaging where residents is not null))
select coalesce(c.imaging_id, r.imaging_id) as imaging_id, coalesce(c.pos, r.pos) as pos, consultant, resident from c full join r on c.imaging_id = r.imaging_id and c.pos = r.pos""")
def position_pairs(spark, d):
    """The i-th consultant beside the i-th resident of a row."""
    i = table(spark, d, "imaging")
    list_ = lambda c: F.transform(F.split(c, "/"), lambda x: F.trim(x))
    return M.positional_zip(i.select("imaging_id", list_("consultant").alias("consultant")), i.select("imaging_id", list_("residents").alias("resident")), ["imaging_id"], "consultant", "resident")


# Cells, words and lines.


@query("""with n as (select entry_id, upload_id, string_split(trim(regexp_replace(name, '\\s+', ' ', 'g')), ' ') as ws from entry where upload_id is not null and trim(name) <> ''),
w as (select entry_id, upload_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i, ws from n),
t as (select upload_id, entry_id, string_agg(case when i = 0 then w when 40 - 6 * length(ws[i]) > 1.8 * 6 then '  ' || w else ' ' || w end, '' order by i) as text from w group by 1, 2)
select upload_id, row_number() over (partition by upload_id order by entry_id) as line, text from t""")
def word_lines(spark, d):
    """Lines put together from positioned words, a wider gap by two blanks."""
    e = table(spark, d, "entry").where("upload_id is not null and trim(name) <> ''")
    w = e.select("upload_id", "entry_id", F.posexplode(F.split(F.trim(F.regexp_replace("name", "\\s+", " ")), " ")).alias("i", "text"))
    # words stand 40 apart and letters are 6 wide
    words = w.select("upload_id", (F.col("entry_id") * 1000 + F.col("i")).alias("ord"), "text", (F.col("i") * 40.0).alias("x"), (F.col("entry_id") * 12.0).alias("y"), (F.length("text") * 6.0).alias("width"))
    return W.lines_of_words(words, ["upload_id"], wide=1.8)


@query("""with c as (select site_code, section, count(distinct imaging_id) as n from imaging where site_code is not null group by 1, 2), b as (select site_code, section from (select *, row_number() over (partition by site_code order by n desc, section nulls first) as r from c) where r = 1)
select i.site_code, i.section, count(*) as cells from imaging i join b on i.site_code = b.site_code and i.section is not distinct from b.section where i.section is not null group by 1, 2""")
def largest_tables(spark, d):
    """The table (section) of most rows of each page (site) (A4)."""
    cells = table(spark, d, "imaging").where("site_code is not null").select("site_code", F.col("section").alias("table"), F.col("imaging_id").alias("row"))
    return W.largest_table(cells, ["site_code"]).groupBy("site_code", F.col("table").alias("section")).agg(F.count("*").alias("cells"))


@query("""select site_code, imaging_id as row, duty_date || ' ' || coalesce(shift, '') as date, case when upper(coalesce(shift, '')) in ('AM', 'PM') then upper(shift) end as half, nullif(trim(regexp_replace(section, '\\s*\\n\\s*', ' ', 'g')), '') as section, nullif(trim(regexp_replace(consultant, '\\s*\\n\\s*', ' ', 'g')), '') as person
from imaging where site_code is not null and regexp_matches(duty_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') and (nullif(trim(regexp_replace(section, '\\s*\\n\\s*', ' ', 'g')), '') is not null or nullif(trim(regexp_replace(consultant, '\\s*\\n\\s*', ' ', 'g')), '') is not null)""")
def cell_rows(spark, d):
    """Typed rows of cells by fallback columns moved to the date's place, labels suppressed, the half of the day from the
    date cell (B1-B3, A4, A6, A7)."""
    i = table(spark, d, "imaging").where("site_code is not null")
    # the date stands in the third column, where the fallback expects the first
    cells = i.select("site_code", F.col("imaging_id").alias("row"), F.posexplode(F.array(F.lit(""), F.lit("."), F.concat("duty_date", F.lit(" "), F.coalesce("shift", F.lit(""))), "section", "consultant")).alias("col", "text"))
    date = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    columns = W.columns_or_fallback(cells, ["site_code"], {"a": "never", "b": "never"}, 2, {"section": 1, "person": 2}, date, 0)
    rows = W.cells_to_rows(cells, ["site_code"], columns, ["section", "person"], date)
    return rows.select("site_code", "row", "date", W.half_of_day(F.col("date")).alias("half"), "section", "person")


@query("""select upper(day_name[1:1]) || lower(day_name[2:3]) as day, count(*) as n from imaging where regexp_matches(trim(day_name), '^(?i)(sun|mon|tue|wed|thu|fri|sat)([a-z]*day)?$') group by 1""")
def day_rows(spark, d):
    """Rows whose first cell is a weekday."""
    return table(spark, d, "imaging").select(W.day_name(F.col("day_name")).alias("day")).where("day is not null").groupBy("day").agg(F.count("*").alias("n"))


_P10 = "regexp_matches(regexp_replace(phone, '[ ()+-]', '', 'g'), '^[0-9]{9,14}$')"


@query(f"""select site_code, contact_id as row, trim(case when length(trim(coalesce(position, ''))) >= 3 and not regexp_matches(regexp_replace(position, '[ ()+-]', '', 'g'), '^[0-9]{{9,14}}$') then position else name end) as name, regexp_replace(phone, '[ ()+-]', '', 'g') as phone from contact where {_P10}
and (length(trim(coalesce(position, ''))) >= 3 or length(trim(coalesce(name, ''))) >= 3)""")
def cell_contacts(spark, d):
    """Contacts read from cells: a phone with the nearest name to its left."""
    c = table(spark, d, "contact")
    cells = c.select("site_code", F.col("contact_id").alias("row"), F.posexplode(F.array("name", "position", "phone")).alias("col", "text"))
    return W.contacts_of_cells(cells, ["site_code"])


@query(f"""with c as (select contact_id, name, {phone('phone')} as p from contact where regexp_matches(name, '^Dr\\.? [A-Za-z ]*[A-Za-z]$')) select contact_id, trim(name) as name, p as phone from c where p is not null""")
def line_contacts(spark, d):
    """Contacts read from lines of a name and a number (A10)."""
    c = table(spark, d, "contact").where(F.col("name").rlike("^Dr\\.? [A-Za-z ]*[A-Za-z]$")).withColumn("p", clean_phone(F.col("phone"))).where("p is not null")
    lines = c.select("contact_id", F.lit(1).alias("ord"), F.concat("name", F.lit("  "), "p").alias("text"))
    return W.contacts_of_lines(lines, ["contact_id"], "ord", "text").select("contact_id", "name", "phone")


@query("""select record_id, snap_no, lpad(split_part(date_text, '/', 1), 2, '0') || '/' || lpad(split_part(date_text, '/', 2), 2, '0') as key, created_at[9:10] || '/' || created_at[6:7] as day from rota_snapshot""")
def date_keys(spark, d):
    """DD/MM keys of typed dates, numeric and with the month's name."""
    s = table(spark, d, "rota_snapshot")
    months = F.array(*[F.lit(m) for m in ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")])
    named = F.concat(F.lit("on "), F.substring("created_at", 9, 2), F.lit("-"), F.element_at(months, F.substring("created_at", 6, 2).cast("int")), F.lit("-26"))
    return s.select("record_id", "snap_no", date_key(F.col("date_text")).alias("key"), date_key(named).alias("day"))


@query("""with t as (select entry_id, starttime as s, endtime as e from entry where regexp_full_match(starttime, '[0-9]{2}:[0-9]{2}') and regexp_full_match(endtime, '[0-9]{2}:[0-9]{2}'))
select entry_id, cast(s[1:2] as int) * 60 + cast(s[4:5] as int) as start_min, cast(e[1:2] as int) * 60 + cast(e[4:5] as int) as end_min from t where cast(s[1:2] as int) * 60 + cast(s[4:5] as int) <= 1440 and cast(e[1:2] as int) * 60 + cast(e[4:5] as int) <= 1440 and cast(s[4:5] as int) < 60 and cast(e[4:5] as int) < 60""")
def time_ranges(spark, d):
    """Start and end of the time ranges in texts."""
    e = table(spark, d, "entry").where(F.col("starttime").rlike("^[0-9]{2}:[0-9]{2}$") & F.col("endtime").rlike("^[0-9]{2}:[0-9]{2}$"))
    r = e.select("entry_id", W.time_range(F.concat(F.lit("shift "), "starttime", F.lit(" - "), "endtime")).alias("r")).where("r is not null")
    return r.select("entry_id", "r.start_min", "r.end_min")


@query("""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[ \\t]+([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})', chr(10) || '\\1', 'g'), ' *(05[0-9]{8}) *', ' \\1 ', 'g'))) as digest from documents""")
def compacted_texts(spark, d):
    """Texts with glued words apart, dates at line starts and numbers set off."""
    return table(spark, d, "documents").select("doc_id", F.md5(W.compacted(F.col("text"))).alias("digest"))


@query(f"""select contact_id, trim(name) as name from contact where {phone('phone')} is not null and regexp_full_match(name, 'Dr\\.? [A-Za-z]+( [A-Za-z]+)*')""")
def phone_names(spark, d):
    """The name on a line with a phone and a role."""
    c = table(spark, d, "contact").withColumn("p", clean_phone(F.col("phone"))).where(F.col("p").isNotNull() & F.col("name").rlike("^Dr\\.? [A-Za-z]+( [A-Za-z]+)*$"))
    line = F.concat(F.lit("12/03 1st On-Call "), F.col("name"), F.lit("  "), F.col("p"), F.lit("  Consultant"))
    return c.select("contact_id", W.name_near_phone(line).alias("name"))


@query("""with r as (select entry_id, string_split(role, ' ') as w from entry where role is not null) select entry_id, case when len(w) >= 2 then w[-2] end as one, case when len(w) >= 3 then w[-3] end as two from r""")
def right_anchored(spark, d):
    """Words of a line counted from its right end."""
    e = table(spark, d, "entry").where("role is not null").select("entry_id", W.from_right(F.split("role", " "), ["one", "two"]).alias("r"))
    return e.select("entry_id", "r.one", "r.two")


@query("""with n as (select entry_id, upload_id, ord % 4 = 1 as h, count(*) filter (ord % 4 = 1) over (partition by upload_id order by entry_id) as block from entry where upload_id is not null),
p as (select *, row_number() over (partition by upload_id, block order by entry_id) as place, count(*) over (partition by upload_id, block) as c from n where block > 0 and not h)
select entry_id, upload_id, block, place from p where c = 3""")
def line_blocks(spark, d):
    """Lines of the blocks that have exactly three of them below their header."""
    lines = table(spark, d, "entry").where("upload_id is not null").select("entry_id", "upload_id", "ord")
    return W.blocks_of(lines, ["upload_id"], "entry_id", F.col("ord") % 4 == 1, 3).select("entry_id", "upload_id", "block", "place")


@query("""with n as (select upload_id, name, entry_id, count(*) filter (ord % 5 = 1) over (partition by upload_id order by entry_id) as block from entry where upload_id is not null and name is not null)
select upload_id, block, string_agg(name, ' / ' order by entry_id) as text from n where block > 0 group by 1, 2""")
def continued_lines(spark, d):
    """Lines joined under the line that starts their block."""
    lines = table(spark, d, "entry").where("upload_id is not null and name is not null").select("upload_id", "entry_id", "ord", "name")
    return W.continuation(lines, ["upload_id"], "entry_id", F.col("ord") % 5 == 1, "name").withColumnRenamed("name", "text")


@query("""select entry_id, role as body from entry where role is not null""")
def between_marks(spark, d):
    """The part of a text between its markers."""
    e = table(spark, d, "entry").where("role is not null")
    text = F.concat(F.lit("page 1 Start: "), F.col("role"), F.lit(" End: "), F.coalesce("section", F.lit("")), F.lit(" Stop"))
    return e.select("entry_id", W.between_markers(text, "start: ", [" end:", " stop"]).alias("body"))


@query("""with l as (select upload_id, string_agg(date_key || ' ' || coalesce(shift_type, 'none'), ' ' order by entry_id) as t, count(*) as n from entry where upload_id is not null and regexp_full_match(date_key, '[0-9]{2}/[0-9]{2}') group by 1),
p as (select upload_id, date_key, coalesce(shift_type, 'none') as segment, row_number() over (partition by upload_id order by entry_id) - 1 as pos, count(*) over (partition by upload_id) as c from entry where upload_id is not null and regexp_full_match(date_key, '[0-9]{2}/[0-9]{2}'))
select upload_id, pos, date_key, segment from p where c >= 2""")
def dated_segments(spark, d):
    """Lines of several dates cut at them."""
    e = table(spark, d, "entry").where(F.col("upload_id").isNotNull() & F.col("date_key").rlike("^[0-9]{2}/[0-9]{2}$"))
    part = F.concat("date_key", F.lit(" "), F.coalesce("shift_type", F.lit("none")))
    lines = X.grouped(e.withColumn("part", part), ["upload_id"], ["entry_id"], ["part"])
    lines = lines.select("upload_id", F.array_join(F.transform("rows", lambda r: r["part"]), " ").alias("text"))
    return W.split_at_dates(lines, F.col("text")).select("upload_id", "pos", "date_key", "segment")


@query("""with n as (select imaging_id, site_code, case lower(day_name[1:3]) when 'sun' then 1 when 'mon' then 2 when 'tue' then 3 when 'wed' then 4 when 'thu' then 5 when 'fri' then 6 when 'sat' then 7 end as dow from imaging where day_name is not null),
r as (select *, row_number() over (partition by site_code, dow order by imaging_id) as k from n where dow is not null),
c as (select cast(x as date) as date, isodow(x) % 7 + 1 as dow, row_number() over (partition by isodow(x) order by x) as k from range(timestamp '2026-03-01', timestamp '2026-04-01', interval 1 day) t(x))
select imaging_id, date from r join c using (dow, k)""")
def weekday_dates(spark, d):
    """The n-th occurrence of a weekday's name as the n-th such day of a month."""
    i = table(spark, d, "imaging").where("day_name is not null")
    dow = F.array_position(F.array(*[F.lit(x) for x in ("sun", "mon", "tue", "wed", "thu", "fri", "sat")]), F.lower(F.left("day_name", F.lit(3))))
    days = i.select("imaging_id", "site_code", F.col("imaging_id").alias("ord"), dow.cast("int").alias("dow")).where("dow > 0")
    return W.nth_weekdays(days, F.lit("2026-03-01").cast("date"), ["site_code"]).select("imaging_id", "date")


@query(f"""with c as (select site_code, contact_id, upper(replace(specialty, '_', '')[1:3]) as abbr, name, {phone('phone')} as p from contact where regexp_full_match(name, 'Dr\\.? [A-Za-z ]*[A-Za-z]') and {phone('phone')} is not null and regexp_full_match(specialty, '[a-z_]+'))
select site_code, abbr, name, p as phone from (select *, row_number() over (partition by site_code, abbr order by contact_id) as n from c) where n = 1""")
def legend_names(spark, d):
    """Abbreviations of a legend with their names and numbers."""
    c = table(spark, d, "contact").withColumn("p", clean_phone(F.col("phone"))).where(F.col("p").isNotNull() & F.col("name").rlike("^Dr\\.? [A-Za-z ]*[A-Za-z]$") & F.col("specialty").rlike("^[a-z_]+$"))
    part = F.concat(F.upper(F.left(F.replace("specialty", F.lit("_"), F.lit("")), F.lit(3))), F.lit("(1) "), "name", F.lit(" "), "p")
    lines = X.grouped(c.withColumn("part", part), ["site_code"], ["contact_id"], ["part"]).select("site_code", F.array_join(F.transform("rows", lambda r: r["part"]), " ; ").alias("text"))
    return W.expand_legend(lines, ["site_code"], "text")


_MARKS = ("rota", "on call|on-call", "ward", "shift")


@query("select parser_mode, count(*) as n, sum(hits) as hits from (select " + " + ".join(f"coalesce(regexp_matches(lower(text), '{m}')::int, 0)" for m in _MARKS) + """ as hits, case when hits >= 3 then 'template' when hits >= 1 then 'table' else 'generic' end as parser_mode from documents) group by 1""")
def template_modes(spark, d):
    """Documents by the parser that their markers choose."""
    t = table(spark, d, "documents").withColumn("hits", W.template_hits(F.lower("text"), _MARKS))
    same = lambda x: x
    out = W.parse_by(t.select("doc_id", "hits"), {"template": (F.col("hits") >= 3, same), "table": (F.col("hits") >= 1, same)}, same)
    return out.groupBy("parser_mode").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))


@query("""select entry_id, case when len(f) > 0 then array_to_string(f, ',') else 'any' end as lanes from (select entry_id, list_filter(['consultant', 'fellow', 'registrar', 'resident'], lambda w: regexp_matches(lower(coalesce(role, '')), '(^|[^\\p{L}])' || w || '($|[^\\p{L}])')) as f from entry)""")
def known_words(spark, d):
    """Known words found in a text, else a fallback."""
    e = W.known_in(table(spark, d, "entry"), F.coalesce("role", F.lit("")), ["consultant", "fellow", "registrar", "resident"], "w", F.array(F.lit("any")))
    return e.select("entry_id", F.array_join(F.array_sort("w"), ",").alias("lanes"))


# Records and audits.


@query("""select upload_id, date_key, string_agg(cast(entry_id as varchar), ',' order by ord nulls first, entry_id) as ids from entry group by 1, 2""")
def grouped_records(spark, d):
    """Entries of an upload and day as one record in order."""
    g = X.grouped(table(spark, d, "entry"), ["upload_id", "date_key"], ["ord", "entry_id"], [])
    return g.select("upload_id", "date_key", F.array_join(F.transform("rows", lambda r: r["entry_id"].cast("string")), ",").alias("ids"))


@query("""with e as (select snap_no, record_id, delivered_at, case when json_type(data, '$.entries') = 'ARRAY' then cast(data->'$.entries' as json[]) when json_type(data) = 'OBJECT' then [data::json] end as es from rota_snapshot where data is not null)
select snap_no, record_id, delivered_at, pos, e->>'$.name' as name, e->>'$.role' as role, e->>'$.phone' as phone from (select snap_no, record_id, delivered_at, generate_subscripts(es, 1) as pos, unnest(es) as e from e)""")
def flat_entries(spark, d):
    """The entries inside the JSON of uploaded records as rows."""
    return X.flattened(table(spark, d, "rota_snapshot"), ["snap_no", "record_id", "delivered_at"], F.col("data"), "entries", "name string, role string, phone string")


@query("""with p as (select imaging_id, site_code, duty_date, lane, trim(x) as person from (select imaging_id, site_code, duty_date, 'consultant' as lane, unnest(string_split(consultant, '/')) as x from imaging union all select imaging_id, site_code, duty_date, 'residents', unnest(string_split(residents, '/')) from imaging union all select imaging_id, site_code, duty_date, 'fellow', unnest(string_split(fellow, '/')) from imaging) where trim(x) <> '')
select imaging_id, site_code, duty_date, lane, person from (select *, row_number() over (partition by site_code, duty_date, person order by case lane when 'consultant' then 1 when 'residents' then 2 else 3 end, imaging_id) as n from p) where n = 1""")
def exclusive_roles(spark, d):
    """One role of a person per site and day, the most important one."""
    i = table(spark, d, "imaging")
    long = i.unpivot(["imaging_id", "site_code", "duty_date"], ["consultant", "residents", "fellow"], "lane", "x").select("imaging_id", "site_code", "duty_date", "lane", F.explode(F.split("x", "/")).alias("x"))
    people = long.withColumn("person", F.trim("x")).where("person <> ''").drop("x")
    return X.exclusive(people, ["site_code", "duty_date"], "person", "lane", ["consultant", "residents"], F.asc("imaging_id")).select("imaging_id", "site_code", "duty_date", "lane", "person")


@query("""select site_code, duty_date, section, shift, imaging_id from (select *, row_number() over (partition by site_code, duty_date, section, shift order by imaging_id) as n from imaging) where n = 1""")
def slot_firsts(spark, d):
    """The first row of each slot."""
    return X.first_per_slot(table(spark, d, "imaging"), ["site_code", "duty_date", "section", "shift"], F.asc("imaging_id")).select("site_code", "duty_date", "section", "shift", "imaging_id")


@query(f"""with s as (select upload_id, name, coalesce(name, '') <> '' as u, lower(coalesce(name, '')) like '%no coverage%' as q, {phone('phone')} is null as np, coalesce(phoneuncertain, false) as unsure, role is null as nr,
  coalesce(regexp_matches(name, '\\S\\s*/\\s*\\S') or {_TITLES.format(x='name')} >= 2, false) as mg, 100 - (case when {phone('phone')} is null then 25 else 0 end) - (case when coalesce(phoneuncertain, false) then 15 else 0 end) - (case when role is null then 20 else 0 end) - (case when duty_date is null then 20 else 0 end) as score from entry where upload_id is not null),
g as (select upload_id, count(*) as rows, count(*) filter (u and not q) as usable, count(*) filter (u and not q and score >= 75) as high, count(*) filter (u and not q and score >= 45) as fair, bool_and(q) as quiet, bool_or(mg and u and not q) as p0, bool_or(np and u and not q) as p1, bool_or(nr and u and not q) as p2 from s group by 1)
select upload_id, rows, usable, high, case when quiet then 'high' when usable = 0 then 'low' when high >= 0.7 * usable then 'high' when fair >= 0.6 * usable then 'medium' else 'low' end as overall,
  array_to_string(list_filter([case when usable = 0 and not quiet then 'no-usable-rows' end, case when p0 then 'merged-names' end, case when p1 then 'missing-phones' end, case when p2 then 'missing-roles' end], lambda x: x is not null), ',') as issues from g""")
def record_audits(spark, d):
    """The audit of each upload from its rows."""
    e = table(spark, d, "entry").where("upload_id is not null")
    no_phone, unsure = clean_phone(F.col("phone")).isNull(), F.coalesce("phoneuncertain", F.lit(False))
    quiet = F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit("no coverage"))
    score = Q.penalty_score([(no_phone, 25), (unsure, 15), (F.col("role").isNull(), 20), (F.col("duty_date").isNull(), 20)])
    problems = [(Q.merged_names(F.col("name")), "merged-names"), (no_phone, "missing-phones"), (F.col("role").isNull(), "missing-roles")]
    out = Q.record_audit(e, ["upload_id"], (F.coalesce("name", F.lit("")) != "") & ~quiet, score, quiet, problems)
    return out.withColumn("issues", F.array_join("issues", ","))


@query("""select upload_id, date_key from entry where upload_id is not null and date_key is not null group by 1, 2 having bool_or(coalesce(lower(role) like '%consultant%', false)) and not bool_or(coalesce(regexp_matches(lower(role), '1st|resident|junior'), false))""")
def tier_gaps(spark, d):
    """Days of an upload with a consultant and nobody of the first tier (H3)."""
    e = table(spark, d, "entry").where("upload_id is not null and date_key is not null")
    return Q.upper_only(e, ["upload_id", "date_key"], F.contains(F.lower("role"), F.lit("consultant")), F.lower("role").rlike("1st|resident|junior"))


@query(f"""with {_STEPS}, e as (select snap_no, specialty, unnest(cast(data->'$.entries' as json[])) as e from rota_snapshot where json_type(data, '$.entries') = 'ARRAY'),
n as (select distinct snap_no, specialty, e->>'$.name' as name, regexp_replace(lower(e->>'$.name'), '[^\\p{{L}}\\p{{N}}]', '', 'g') as c from e where e->>'$.name' is not null and length(regexp_replace(lower(e->>'$.name'), '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 4),
a as (select t.snap_no, specialty, name, c from n join steps t on n.snap_no = t.prior)
select distinct a.snap_no, a.specialty, a.name from a where not exists (select 1 from n b where b.snap_no = a.snap_no and b.specialty is not distinct from a.specialty and (contains(a.c, b.c) or contains(b.c, a.c))) and a.specialty is not null""")
def lost_consultants(spark, d):
    """Names of a specialty's records that the next snapshot has nothing of (H8)."""
    rows = X.flattened(table(spark, d, "rota_snapshot"), ["snap_no", "specialty"], F.col("data"), "entries", "name string").where("specialty is not null and name is not null")
    old, new = consecutive(rows.select("snap_no", "specialty", "name"), "snap_no")
    return Q.lost_names(old, new, ["snap_no", "specialty"], "name")


@query("""with l as (select label from specialty where label is not null union select upper(replace(specialty, '_', '__')) from specialty union select section from imaging where section is not null)
select label, regexp_matches(label, '^[A-Z0-9 ]{12,}$|[0-9]{3,}|[_*#|<>{}]|\\s{2,}') as noisy, array_to_string(list_transform(string_split(lower(trim(regexp_replace(regexp_replace(label, '[_*#|<>{}]+', ' ', 'g'), '\\s+', ' ', 'g'))), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as clean from l""")
def noisy_labels(spark, d):
    """Labels that look messy, and what they are in clean form (H9)."""
    s = table(spark, d, "specialty")
    labels = s.select("label").where("label is not null").unionByName(s.select(F.upper(F.replace("specialty", F.lit("_"), F.lit("__"))).alias("label"))).unionByName(table(spark, d, "imaging").select(F.col("section").alias("label")).where("label is not null")).distinct()
    return labels.select("label", Q.label_noise(F.col("label")).alias("noisy"), Q.clean_label(F.col("label")).alias("clean"))


@query("""with b as (select specialty, cast(floor(count(distinct name) * 0.5) as bigint) as low, cast(count(distinct name) * 2 as bigint) as high from contact group by 1)
select e.specialty, count(distinct e.name) as n, any_value(low) as low, any_value(high) as high, case when any_value(low) is null then 'unknown' when count(distinct e.name) < any_value(low) then 'few' when count(distinct e.name) > any_value(high) then 'many' else 'ok' end as state from entry e left join b on e.specialty = b.specialty group by 1""")
def name_bounds(spark, d):
    """Distinct names of each specialty against the range its contacts suggest."""
    n = F.countDistinct("name")
    bounds = table(spark, d, "contact").groupBy("specialty").agg(F.floor(n * 0.5).alias("low"), (n * 2).alias("high"))
    return Q.outside_bounds(table(spark, d, "entry"), ["specialty"], "name", bounds, "low", "high")


@query("""with a as (select distinct modality, section from imaging where shift = 'AM') select imaging_id, a.modality is not null as locked from imaging i left join a on i.modality = a.modality and i.section = a.section""")
def section_lock(spark, d):
    """Rows whose section and modality are an allowed combination."""
    i = table(spark, d, "imaging")
    return Q.allowed_only(i, ["modality", "section"], i.where("shift = 'AM'").select("modality", "section")).select("imaging_id", "locked")


@query("""with s as (select upload_id, case status when 'success' then 92 when 'partial' then 84 when 'error' then 30 else 52 end - (case when not parsed_active then 12 else 0 end) - (case when entries_count is null then 25 else 0 end) - (case when entries_count < 5 then 18 else 0 end) as s, coalesce(is_active and entries_count >= 3, false) as f, not parsed_active as p1, entries_count is null as p2, entries_count < 5 as p3 from upload)
select upload_id, least(greatest(case when f then greatest(s, 72) else s end, 0), 100) as score, array_to_string(list_filter([case when p1 then 1 end, case when p2 then 2 end, case when p3 then 3 end], lambda x: x is not null), ',') as reasons from s""")
def trust_scores(spark, d):
    """Trust in each upload: a base by state, penalties, a floor, between 0 and 100."""
    base = F.when(F.col("status") == "success", 92).when(F.col("status") == "partial", 84).when(F.col("status") == "error", 30).otherwise(52)
    score, reasons = Q.trust(base, [(~F.col("parsed_active"), 12), (F.col("entries_count").isNull(), 25), (F.col("entries_count") < 5, 18)], (F.col("is_active") & (F.col("entries_count") >= 3), 72))
    return table(spark, d, "upload").select("upload_id", score.alias("score"), F.array_join(F.transform(reasons, lambda r: r.cast("string")), ",").alias("reasons"))


@query("""with r as (select specialty from entry where confidence = 'high' and specialty is not null group by 1 having count(distinct date_key) >= 40)
select entry_id from entry where specialty is not null and case when specialty in (select specialty from r) then confidence = 'high' else coalesce(confidence, '') <> 'high' end""")
def guarded_replace(spark, d):
    """Rows of high confidence where they name 40 days or more, else the others."""
    e = table(spark, d, "entry").select("entry_id", "specialty", "date_key", F.coalesce("confidence", F.lit("")).alias("c"))
    return X.replaced_if(e.where("c <> 'high'"), e.where("c = 'high'"), ["specialty"], "date_key", 40).select("entry_id")


@query("""select upload_id, case when status = 'error' then 'rejected' when row_number() over (partition by site_code, specialty, coalesce(status = 'error', false) order by uploaded_at desc nulls last, upload_id desc) = 1 then 'active' else 'past' end as state from upload""")
def upload_states(spark, d):
    """Which upload holds: rejected ones never replace what holds."""
    u = X.accepted_history(table(spark, d, "upload"), ["site_code", "specialty"], "uploaded_at", [F.desc_nulls_last("uploaded_at"), F.desc("upload_id")], F.col("status") == "error")
    return u.select("upload_id", "state")


@query("""with m as (select specialty, split_part(specialty, '_', 1) as whole from specialty) select whole, count(*) as n from rota_edit e join m on e.specialty = m.specialty group by 1""")
def whole_specialties(spark, d):
    """Edits under the larger specialty that theirs is a part of."""
    m = table(spark, d, "specialty").select(F.split_part("specialty", F.lit("_"), F.lit(1)).alias("whole"), F.col("specialty").alias("part"))
    return X.membership(table(spark, d, "rota_edit"), "specialty", m, "whole", "part").groupBy("whole").agg(F.count("*").alias("n"))


@query("""with m as (select specialty, 'hidden_' || specialty as new from specialty where coalesce(hidden, false) or coalesce(uploaded_only, false)) select contact_id, coalesce(m.new, c.specialty) as specialty from contact c left join m on c.specialty = m.specialty""")
def renamed_specialties(spark, d):
    """Contacts under renamed keys."""
    names = table(spark, d, "specialty").where("coalesce(hidden, false) or coalesce(uploaded_only, false)").select(F.col("specialty").alias("old"), F.concat(F.lit("hidden_"), "specialty").alias("new"))
    return X.renamed_keys(table(spark, d, "contact").select("contact_id", "specialty"), "specialty", names, "old", "new")


@query("""with v as (select upload_id, arg_max(confidence, entry_id) as c, max(received_at) as at from entry where upload_id is not null and confidence is not null group by 1)
select upload_id, u.specialty as old, 'review' as new, v.at from upload u join v using (upload_id) where c <> 'high'""")
def moved_uploads(spark, d):
    """Uploads whose last entry is unsure, moved: the log of the moves."""
    moves = table(spark, d, "entry").where("upload_id is not null and confidence is not null").groupBy("upload_id").agg(F.max_by("confidence", "entry_id").alias("c"), F.max("received_at").alias("at"))
    moves = moves.where("c <> 'high'").withColumn("specialty", F.lit("review"))
    return X.moved(table(spark, d, "upload").select("upload_id", "specialty", "uploaded_at"), moves, "upload_id", "specialty", "at", "uploaded_at")[1]


@query("""with k as (select specialty as key, unnest(keywords) as w from specialty union all select section, unnest(search_aliases) from imaging where section is not null), a as (select distinct key, lower(trim(w)) as w from k where trim(w) <> ''),
all_ as (select specialty as key from specialty where specialty is not null union select section from imaging where section is not null)
select all_.key, coalesce(string_agg(w, ',' order by w), '') as words from all_ left join a using (key) group by 1""")
def united_keywords(spark, d):
    """Keywords of specialties and sections as sets."""
    s = table(spark, d, "specialty").select(F.col("specialty").alias("key"), F.col("keywords").alias("words"))
    i = table(spark, d, "imaging").select(F.col("section").alias("key"), F.col("search_aliases").alias("words"))
    return X.united_keywords(s, i, "key", "words").select("key", F.array_join("words", ",").alias("words"))


@query("""select upload_id, coalesce(nullif(trim(pdf_url), ''), nullif(trim('local/' || filename), ''), 'none') as link from upload""")
def upload_links(spark, d):
    """The link of each upload: the newer place before the older one."""
    return table(spark, d, "upload").select("upload_id", X.link_choice(F.col("pdf_url"), F.concat(F.lit("local/"), "filename"), F.lit("none")).alias("link"))


@query(f"""select specialty, array_to_string(list_sort(list(distinct {_ROLE.format(x='role')}) filter (role is not null)), ',') as roles from entry group by 1""")
def role_lists(spark, d):
    """Distinct roles of each specialty, sorted."""
    r = F.lower(F.trim(F.regexp_replace("role", "\\s+", " ")))
    return table(spark, d, "entry").groupBy("specialty").agg(F.array_join(F.sort_array(F.collect_set(r)), ",").alias("roles"))


@query("""select entry_id, row_number() over (partition by upload_id order by try_cast(split_part(date_key, '/', 2) as int) * 100 + try_cast(split_part(date_key, '/', 1) as int) nulls last, lower(role) nulls last, ord, entry_id) as place from entry where upload_id is not null and (date_key is null or regexp_full_match(date_key, '\\d{1,2}/\\d{1,2}'))""")
def sorted_rows(spark, d):
    """Rows of an upload sorted by DD/MM day, role and place."""
    from pyspark.sql import Window

    e = table(spark, d, "entry").where(F.col("upload_id").isNotNull() & (F.col("date_key").isNull() | F.col("date_key").rlike("^\\d{1,2}/\\d{1,2}$")))
    w = Window.partitionBy("upload_id").orderBy(F.asc_nulls_last(T.month_day(F.col("date_key"))), F.asc_nulls_last(F.lower("role")), F.asc("ord"), F.asc("entry_id"))
    return e.select("entry_id", F.row_number().over(w).alias("place"))


@query("""select u.upload_id from upload u left join (select site_code, specialty, max(uploaded_at) as k from upload where coalesce(is_active, false) group by 1, 2) l on u.site_code = l.site_code and u.specialty = l.specialty where k is null or u.uploaded_at > k""")
def newer_uploads(spark, d):
    """Uploads newer than the active one of their site and specialty, or where there is none."""
    u = table(spark, d, "upload")
    return K.newer_only(u.where("coalesce(is_active, false)"), u, ["site_code", "specialty"], "uploaded_at").select("upload_id")


@query("""select contact_id, name, phone, position from contact""")
def csv_round_trip(spark, d):
    """Contacts written as CSV and read again."""
    import uuid

    from watchbill.sources.files import read_csv, write_csv

    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, d, "contact").select("contact_id", "name", "phone", "position")
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


@query("""select user_id, min(ts) as session_start, max(ts) as last_ts, count(*) as n from (select *, sum(case when gap is null or gap >= interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) as gap from events)) group by user_id, s""")
def user_sessions(spark, d):
    """Sessions of each user that half an hour without an event ends."""
    from watchbill.streaming.clicks import session_counts

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = session_counts(e, "ts", "user_id", "30 minutes", "1 hour")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), (F.col("session_end").cast("timestamp_ntz") - F.expr("INTERVAL '30' MINUTE")).alias("last_ts"), "n")


@query("""select site_code, doctor, edit_id, role from (select *, row_number() over (partition by site_code, doctor order by created_at desc nulls last, edit_id desc) as n from rota_edit where doctor is not null and site_code is not null) where n = 1""")
def latest_stream(spark, d):
    """Edits read as a stream and kept as the newest of each person (L4)."""
    import uuid

    from watchbill.streaming.clicks import keep_latest, latest_state, read_events

    name = uuid.uuid4().hex
    first = table(spark, d, "rota_edit").inputFiles()[0]
    folder, file = first.rsplit("/", 1)
    stream = read_events(spark, folder, "*.parquet" if folder.endswith("rota_edit.parquet") else file).where("doctor is not null and site_code is not null")
    path = f"{shared_dir(spark)}/latest-{name}"
    keep_latest(stream.select("site_code", "doctor", "edit_id", "role", "created_at"), ["site_code", "doctor"], "created_at", "edit_id", path, name).awaitTermination()
    return latest_state(spark, path, "site_code string, doctor string, edit_id bigint, role string, created_at timestamp_ntz").select("site_code", "doctor", "edit_id", "role")


@query("""with c as (select entry_id, not coalesce(regexp_full_match(date_key, '[0-9]{1,2}/[0-9]{1,2}'), false) as d, not coalesce(length(trim(name)) between 3 and 80, false) as n, phone is not null and not regexp_full_match(phone, '05[0-9]{8}') as p, coalesce(trim(role), '') = '' as r from entry)
select entry_id, array_to_string(list_filter([case when d then 'date' end, case when n then 'name' end, case when p then 'phone' end, case when r then 'role' end], lambda x: x is not null), ',') as invalid from c where d or n or p or r""")
def field_checks(spark, d):
    """Fields of entries that are not as they must be."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    checks = [
        (no(F.col("date_key").rlike("^[0-9]{1,2}/[0-9]{1,2}$")), "date"), (no(F.length(F.trim("name")).between(3, 80)), "name"),
        (F.col("phone").isNotNull() & ~F.col("phone").rlike("^05[0-9]{8}$"), "phone"), (F.coalesce(F.trim("role"), F.lit("")) == "", "role")]
    found = table(spark, d, "entry").select("entry_id", F.explode(F.array(Q.issues(checks))).alias("i"))
    return found.where(F.size("i") > 0).select("entry_id", F.array_join("i", ",").alias("invalid"))


@query("""select label, substr('custom_' || regexp_replace(regexp_replace(lower(trim(label)), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) as key from (select label from specialty union select section from imaging union select filename from upload) where label is not null""")
def custom_keys(spark, d):
    """Keys made of labels and file names."""
    labels = table(spark, d, "specialty").select("label").unionByName(table(spark, d, "imaging").select(F.col("section").alias("label"))).unionByName(table(spark, d, "upload").select(F.col("filename").alias("label")))
    return labels.where("label is not null").distinct().select("label", slug(F.col("label")).alias("key"))


@query("""with c as (select entry_id, string_split(regexp_replace(role, '\\s+', ' ', 'g'), ' ') as w from entry where role is not null) select entry_id, array_to_string(case when len(w) = 2 then w when len(w) = 3 then [w[1], w[2] || ' ' || w[3]] else [array_to_string(w[1:len(w) - 4], ' '), array_to_string(w[len(w) - 3:], ' ')] end, '|') as parts from c where len(w) between 2 and 3""")
def word_partitions(spark, d):
    """Words of a role split into exactly two runs, by the best score."""
    e = table(spark, d, "entry").where("role is not null").withColumn("w", F.split(F.regexp_replace("role", "\\s+", " "), " ")).where(F.size("w").between(2, 3))
    return W.partition_tokens(e, "w", ["no such name"], groups=2, widest=4).select("entry_id", F.array_join("parts", "|").alias("parts"))


@query("""select entry_id, case when lower(role) like '%consultant%' then 'senior' when lower(role) like '%fellow%' then 'middle' when lower(role) like '%registrar%' then 'middle' when lower(role) like '%resident%' then 'junior' else 'unknown' end as tier from entry""")
def hinted_tiers(spark, d):
    """A tier for each role by a table of hints, else a fallback."""
    hints = spark.createDataFrame([("consultant", 1, "senior"), ("fellow", 2, "middle"), ("registrar", 3, "middle"), ("resident", 4, "junior")], "hint string, ord int, tier string")
    e = table(spark, d, "entry").select("entry_id", "role")
    return rule_join(e, "role", hints, "hint", "ord", "tier", ["entry_id"]).withColumn("tier", F.coalesce("tier", F.lit("unknown")))


@query("""select contact_id, case when list_position(['R1', 'R2', 'R3', 'R4', 'R5'], rank) > coalesce(list_position(['R1', 'R2', 'R3', 'R4', 'R5'], 'R2'), 0) then rank else 'R2' end as label from contact""")
def raised_labels(spark, d):
    """The label of a column, or the higher rank of the person under it."""
    return table(spark, d, "contact").select("contact_id", X.raised(F.lit("R2"), F.col("rank"), ["R1", "R2", "R3", "R4", "R5"]).alias("label"))


@query("""with i as (select * from (values ('night', 'intervention'), ('night', 'ct'), ('scan', 'mri')) t(intent, word))
select i.intent, m.imaging_id from imaging m join i on contains(lower(m.section), i.word) group by 1, 2""")
def intent_sections(spark, d):
    """Rows of the sections that an intent stands for."""
    intents = spark.createDataFrame([("night", "intervention"), ("night", "ct"), ("scan", "mri")], "intent string, word string")
    m = table(spark, d, "imaging").select("imaging_id", F.lower("section").alias("s"))
    return m.join(F.broadcast(intents), F.contains("s", F.col("word"))).select("intent", "imaging_id").distinct()  # three stated words


@query(f"""with k as (select site_code, {canon('name')} as key, {phone('phone')} as p from contact where {phone('phone')} is not null and site_code is not null and {canon('name')} <> ''), c as (select distinct site_code, key, p from k),
r as (select e.site_code, {canon('e.name')} as key, {phone('e.phone')} as p from entry e where {phone('e.phone')} is not null and e.site_code is not null and {canon('e.name')} <> ''),
n as (select site_code, key, min(p) as p from r where (site_code, key) not in (select (site_code, key) from c) group by 1, 2)
select site_code, key, p from c union all select site_code, key, p from n""")
def appended_contacts(spark, d):
    """Contacts of each site, and the numbers of entries whose names they lack."""
    def known(name: str) -> DataFrame:
        t = table(spark, d, name).select("site_code", canonical_name(F.col("name")).alias("key"), clean_phone(F.col("phone")).alias("p"))
        return t.where("p is not null and site_code is not null and key <> ''")

    return X.appended(known("contact").distinct(), known("entry"), ["site_code", "key"])


@query(f"""with p as (select {phone('phone')} as p, arg_max(name, contact_id) as n from contact where {phone('phone')} is not null and name is not null group by 1), e as (select edit_id, doctor, {phone('phone')} as p from rota_edit)
select edit_id, case when string_split({_NORM.format(x='n')}, ' ')[-1] = string_split({_NORM.format(x='doctor')}, ' ')[-1] and trim(n) <> '' then n else doctor end as doctor from e left join p on e.p = p.p""")
def accepted_names(spark, d):
    """Edits with the name known for their number, where the last word stays the same."""
    c = table(spark, d, "contact").withColumn("p", clean_phone(F.col("phone"))).where("p is not null and name is not null").groupBy("p").agg(F.max_by("name", "contact_id").alias("doctor"))
    e = table(spark, d, "rota_edit").select("edit_id", "doctor", clean_phone(F.col("phone")).alias("p"))
    return X.accepted_names(e, c, ["p"], "doctor").select("edit_id", "doctor")
