"""Queries of the roster operators over the tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchbill.functions import timeops as T
from watchbill.functions.clock import clock_minute, let
from watchbill.functions.rules import lane
from watchbill.functions.text import canonical_name, clean_phone, normalized_text
from watchbill.operators import analytics as A
from watchbill.operators import matching as M
from watchbill.operators import quality as Q
from watchbill.operators import resolve as R
from watchbill.operators import rows as W
from watchbill.operators import search as S
from watchbill.operators import store as K
from watchbill.operators import windows as G
from watchbill.operators.snapshots import consecutive
from watchbill.plans.problems import _MINUTE
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


# Roles looked for in every rota, and lanes by pattern in their order.
ROLES = ("1st on-call", "2nd on-call", "3rd on-call", "associate on-duty", "consultant on-call", "consultant on-duty", "fellow second", "hospitalist ward", "resident er", "senior registrar")
LANES = (("consultant", "consultant", None), ("ward", "ward|hospitalist", None), ("emergency", "\\ber\\b", None), ("first", "1st|junior", None), ("second", "2nd|second", "fellow"), ("fellow", "fellow", None), ("senior", "senior|3rd", None), ("other", ".", None))

_CANON = """array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '^dr\\.?\\s*', ' '), '\\([^)]*\\)', ' ', 'g'), '\\bdr\\b\\.?', ' ', 'g'), '-', ''), '[^a-z0-9\u0600-ۿ]+', ' ', 'g')), ' '), lambda w: w not in ('al', 'el', '')), lambda w: regexp_replace(w, '^(?:al|el)([a-z]{{2,}})$', '\\1')), ' ')"""
_DIGITS = "regexp_replace(translate({x}, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[^0-9]', '', 'g')"
_PHONE = f"nullif(regexp_extract(regexp_replace(regexp_replace({_DIGITS}, '^(?:00)?966', ''), '^(5[0-9]{{{{8}}}})$', '0\\1'), '^05[0-9]{{{{8}}}}$'), '')"
_ROLE = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def canon(x: str) -> str:
    return _CANON.format(x=x)


def phone(x: str) -> str:
    return _PHONE.format(x=x)


def _role(column: str = "role"):
    return F.lower(F.trim(F.regexp_replace(column, "\\s+", " ")))


@query("""with newest as (select * from events order by ts desc, event_id desc limit 10000)
select event_type, count(*) as n, max(ts) as newest from newest group by event_type order by n desc, newest desc, event_type limit 10""")
def recent_topk(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent event types among the newest 10,000 events."""
    return G.recent_top(table(spark, d, "events"), "event_type", "ts", "event_id", 10_000, 10)


@query("""with m as (select max(ts) as now from events)
select event_type, count(*) filter (ts >= date_trunc('day', now)) as today, count(*) filter (ts >= now - interval 1 day) as last_24h,
  count(*) filter (ts >= now - interval 7 day) as last_7d, count(*) filter (ts >= now - interval 30 day) as last_30d, count(*) filter (ts >= timestamp '2020-01-01') as ever
from events, m group by event_type""")
def range_counts(spark, d):
    """Events by named ranges of time before the newest one."""
    e = table(spark, d, "events")
    both = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    cols = {"today": "today", "24h": "last_24h", "7d": "last_7d", "30d": "last_30d", "all": "ever"}
    return both.groupBy("event_type").agg(*[F.count_if(F.col("ts") >= T.range_start(r, F.col("now"))).alias(n) for r, n in cols.items()])


@query("""select specialty, count(*) as total, count(*) filter (status in ('success', 'partial')) as good, cast(floor(count(*) filter (status in ('success', 'partial')) * 100.0 / count(*) + 0.5) as bigint) as rate from upload group by specialty""")
def status_stats(spark, d):
    """Uploads and success rate per specialty."""
    return A.status_rates(table(spark, d, "upload"), ["specialty"], "status", ["success", "partial"])


@query("""select upload_id, site_code, specialty, entries_count from (select *, row_number() over (partition by site_code, specialty order by coalesce(entries_count, 0) > 0 desc, uploaded_at desc nulls last, upload_id) as n from upload) where n = 1""")
def best_upload(spark, d):
    """The upload that counts for each site and specialty: with entries, latest, first seen."""
    return R.current_upload(table(spark, d, "upload"), ["site_code", "specialty"]).select("upload_id", "site_code", "specialty", "entries_count")


@query("""select site_code, specialty, edit_id, action from (select *, row_number() over (partition by site_code, specialty order by created_at desc nulls last, edit_id) as n from rota_edit) where n = 1""")
def latest_edit(spark, d):
    """Newest edit per site and specialty."""
    return G.best_by(table(spark, d, "rota_edit"), ["site_code", "specialty"], F.desc_nulls_last("created_at"), F.asc("edit_id")).select("site_code", "specialty", "edit_id", "action")


@query(f"""select entry_id, specialty, date_key, canon, phone_key, role_key from (
  select entry_id, specialty, date_key, {canon('name')} as canon, {phone('phone')} as phone_key, {_ROLE.format(x='role')} as role_key,
    row_number() over (partition by site_code, specialty, date_key, {canon('name')}, {phone('phone')}, {_ROLE.format(x='role')} order by entry_id) as n from entry) where n = 1""")
def first_wins_dedup(spark, d):
    """First row of each site, specialty, date, canonical name, phone and role."""
    e = table(spark, d, "entry").select("entry_id", "site_code", "specialty", "date_key", canonical_name(F.col("name")).alias("canon"), clean_phone(F.col("phone")).alias("phone_key"), _role().alias("role_key"))
    return G.best_by(e, ["site_code", "specialty", "date_key", "canon", "phone_key", "role_key"], F.asc("entry_id")).drop("site_code")


@query(f"""select entry_id from (select entry_id, row_number() over (partition by lower(name), {_ROLE.format(x='role')}, date_key order by entry_id) as n from entry) where n <= 3""")
def cap3_dedup(spark, d):
    """At most three rows of a name, role and date."""
    e = table(spark, d, "entry").select("entry_id", F.lower("name").alias("n"), _role().alias("r"), "date_key")
    return G.cap_per_key(e, ["n", "r", "date_key"], 3, F.asc("entry_id")).select("entry_id")


@query(f"""select entry_id, upload_id, date_key from (select entry_id, upload_id, date_key, row_number() over (partition by upload_id, date_key, {_ROLE.format(x='role')} order by
  (case when phone is not null then 2 else 0 end) + (case when not coalesce(phoneuncertain, false) then 1 else 0 end) desc, length(coalesce(name, '')) desc, entry_id desc) as n from entry) where n = 1""")
def keep_preferred(spark, d):
    """Of the rows of one upload, date and role the one with a phone, certain, longest name, last on ties."""
    score = F.when(F.col("phone").isNotNull(), 2).otherwise(0) + F.when(~F.coalesce("phoneuncertain", F.lit(False)), 1).otherwise(0)
    e = table(spark, d, "entry").withColumn("r", _role())
    return G.best_by(e, ["upload_id", "date_key", "r"], F.desc(score), F.desc(F.length(F.coalesce("name", F.lit("")))), F.desc("entry_id")).select("entry_id", "upload_id", "date_key")


@query("""with k as (select entry_id, concat_ws('|', cast(coalesce(upload_id, -1) as varchar), coalesce(name, chr(57584)), coalesce(date_key, chr(57584)), coalesce(substr(role, 1, 12), chr(57584)), coalesce(starttime, chr(57584)), coalesce(endtime, chr(57584))) as k from entry),
f as (select k, min(entry_id) as first from k group by k having count(*) > 1)
select first, entry_id as later from k join f using (k) where entry_id > first""")
def duplicate_rows(spark, d):
    """Rows that repeat an earlier one of the same upload, name, date, role and times."""
    keys = [F.coalesce(F.col("upload_id"), F.lit(-1)), F.col("name"), F.col("date_key"), F.substring("role", 1, 12), F.col("starttime"), F.col("endtime")]
    return Q.duplicates(table(spark, d, "entry"), keys, "entry_id")


@query("""with n as (select specialty, entries_count as v, row_number() over (partition by site_code, specialty order by uploaded_at desc nulls last, upload_id desc) as n, site_code from upload),
t as (select site_code, specialty, max(case when n = 1 then v end) as latest, max(case when n = 2 then v end) as previous, count(*) as c from n where n <= 2 group by site_code, specialty)
select site_code, specialty, latest, previous, case when c < 2 or coalesce(latest, 0) = 0 then 'yellow' when previous > 0 and (latest - previous) * 1.0 / previous < -0.3 then 'red' when previous > 0 and (latest - previous) * 1.0 / previous < -0.15 then 'yellow' else 'green' end as health from t""")
def trend_health(spark, d):
    """Entries of the latest upload against the one before, per site and specialty."""
    out = A.trend(table(spark, d, "upload"), ["site_code", "specialty"], [F.desc_nulls_last("uploaded_at"), F.desc("upload_id")], "entries_count")
    return out.drop("change")


@query(f"""select specialty, count(*) as n, count(distinct name) as names, count(distinct date_key) as dates, count(distinct {phone('phone')}) as phones from entry group by specialty""")
def distinct_counts(spark, d):
    """Distinct names, dates and phones per specialty, exact."""
    e = table(spark, d, "entry").withColumn("p", clean_phone(F.col("phone")))
    return e.groupBy("specialty").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.countDistinct("date_key").alias("dates"), F.countDistinct("p").alias("phones"))


@query("""select imaging_id, lane, name, case lane when 'consultant' then 1 when 'residents' then 3 else 2 end as tier from (unpivot (select imaging_id, consultant, residents, fellow from imaging) on consultant, residents, fellow into name lane value name) where trim(name) <> ''""")
def lane_unpivot(spark, d):
    """The people columns of imaging as rows with their tiers."""
    i = table(spark, d, "imaging").select("imaging_id", "consultant", "residents", "fellow")
    return W.lanes_to_rows(i, ["imaging_id"], {"consultant": {"tier": 1}, "fellow": {"tier": 2}, "residents": {"tier": 3}})


@query("""select imaging_id, coalesce(nullif(trim(fellow), ''), nullif(trim(consultant), ''), nullif(trim(residents), '')) as person from imaging""")
def dual_column_coalesce(spark, d):
    """First non-empty of several columns."""
    return table(spark, d, "imaging").select("imaging_id", W.first_non_empty(F.col("fellow"), F.col("consultant"), F.col("residents")).alias("person"))


@query("""select entry_id, last_value(section ignore nulls) over (partition by upload_id order by ord, entry_id rows unbounded preceding) as section, lag(date_key) over (partition by upload_id order by ord, entry_id) as date_before, lead(date_key) over (partition by upload_id order by ord, entry_id) as date_after from entry""")
def carry_forward(spark, d):
    """Sections carried down the rows of an upload, and the neighbouring rows' dates."""
    e = table(spark, d, "entry").select("entry_id", "upload_id", "ord", "section", "date_key")
    w = Window.partitionBy("upload_id").orderBy("ord", "entry_id")
    filled = G.carry_forward(e, ["upload_id"], [F.asc("ord"), F.asc("entry_id")], ["section"])
    return filled.select("entry_id", "section", F.lag("date_key").over(w).alias("date_before"), F.lead("date_key").over(w).alias("date_after"))


@query(f"""select contact_id, {canon('name')} as canon, {phone('phone')} as phone_key from contact""")
def canonical_keys(spark, d):
    """Canonical names and phones of all contacts (K)."""
    return table(spark, d, "contact").select("contact_id", canonical_name(F.col("name")).alias("canon"), clean_phone(F.col("phone")).alias("phone_key"))


@query("""select doc_id, length(t) as letters, md5(t) as digest from (select doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) as t from documents)""")
def normalized_texts(spark, d):
    """Documents normalised: lower case, letters and digits only (K)."""
    t = table(spark, d, "documents").select("doc_id", normalized_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("letters"), F.md5("t").alias("digest"))


@query("""with k as (select specialty, try_cast(split_part(date_key, '/', 2) as int) * 100 + try_cast(split_part(date_key, '/', 1) as int) as md from entry where regexp_full_match(date_key, '\\d{1,2}/\\d{1,2}'))
select specialty, min(md) as first_day, max(md) as last_day, count(distinct md // 100) as months from k group by specialty""")
def date_ranges(spark, d):
    """First and last day and months of each specialty by DD/MM keys."""
    e = table(spark, d, "entry").withColumn("md", T.month_day(F.col("date_key"))).where("md is not null")
    return e.groupBy("specialty").agg(F.min("md").alias("first_day"), F.max("md").alias("last_day"), F.countDistinct(F.floor(F.col("md") / 100)).alias("months"))


@query("""with c as (select upload_id, month(duty_date) as month, year(duty_date) as year, count(*) as n, min(ord) as f from entry where duty_date is not null group by all)
select upload_id, month, year, n from (select *, row_number() over (partition by upload_id order by n desc, f, year, month) as r from c) where r = 1""")
def month_mode(spark, d):
    """The month most days of an upload lie in, first seen on ties."""
    e = table(spark, d, "entry").where("duty_date is not null").withColumn("day", F.date_format("duty_date", "dd/MM/yyyy"))
    texts = e.groupBy("upload_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "entry_id", "day"))), lambda r: r["day"]), " ").alias("text"))
    return W.month_mode(texts, "text", ["upload_id"], 2000)


_HEADERS = {"mri": "mri", "sound": "ultra|sono", "intervention": "interv|\\bir\\b", "evening": "^pm$"}


@query("""with c as (select site_code, imaging_id as row, 0 as col, section as text from imaging union all select site_code, imaging_id, 1, modality from imaging union all select site_code, imaging_id, 2, shift from imaging),
n as (select site_code, row, min(col) as col, case when regexp_matches(lower(text), 'mri') then 'mri' when regexp_matches(lower(text), 'ultra|sono') then 'sound' when regexp_matches(lower(text), 'interv|\\bir\\b') then 'intervention' when regexp_matches(lower(text), '^pm$') then 'evening' end as name from c group by site_code, row, name),
r as (select site_code, min(row) as row from (select site_code, row from n where name is not null group by site_code, row having count(*) >= 2) group by site_code)
select n.site_code, n.row, name, col from n join r on n.site_code = r.site_code and n.row = r.row where name is not null""")
def header_detect(spark, d):
    """Columns named by the first row of a site in which two header patterns are found (B1, B2)."""
    i = table(spark, d, "imaging")
    cells = i.select("site_code", F.col("imaging_id").alias("row"), F.posexplode(F.array("section", "modality", "shift")).alias("col", "text"))
    return W.detect_header(cells, ["site_code"], _HEADERS, 2)


@query("""select cast(ts - interval 450 minute as date) as day, count(*) as n, count(*) filter (hour(ts) * 60 + minute(ts) >= 450 and hour(ts) * 60 + minute(ts) < 990) as work_hours, count(*) filter (dayofweek(ts) in (5, 6)) as weekend from events group by 1""")
def schedule_days(spark, d):
    """Events by business day with a cut at 07:30, in work hours and at weekends."""
    e = table(spark, d, "events")
    return e.groupBy(T.schedule_date(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.count_if(T.is_work_hours(F.col("ts"))).alias("work_hours"), F.count_if(T.is_weekend(F.to_date("ts"))).alias("weekend"))


_TYPED = "lower(trim(translate({x}, '٠١٢٣٤٥٦٧٨٩', '0123456789')))"
_MINUTES = f"select *, {_MINUTE.format(t='st')} as a, {_MINUTE.format(t='et')} as b from (select *, {_TYPED.format(x='starttime')} as st, {_TYPED.format(x='endtime')} as et from entry)"


@query(f"""with m as ({_MINUTES}), f as (select *, case when b > a then 120 >= a and 120 < b else 120 >= a or 120 < b end as on_ from m)
select specialty, count(*) as n, count(*) filter (on_) as active, count(*) filter (a is null) as no_start, min(a) as earliest from f group by specialty""")
def range_active_wrap(spark, d):
    """Rows in force at 02:00, with windows over midnight."""
    e = table(spark, d, "entry").select("specialty", clock_minute(F.col("starttime")).alias("a"), clock_minute(F.col("endtime")).alias("b"))
    on = T.range_active(F.lit(120), F.col("a"), F.col("b"))
    return e.groupBy("specialty").agg(F.count("*").alias("n"), F.count_if(F.coalesce(on, F.lit(False))).alias("active"), F.count_if(F.col("a").isNull()).alias("no_start"), F.min("a").alias("earliest"))


@query(f"""with m as ({_MINUTES}), f as (select *, lower(coalesce(name, '')) like '%no coverage%' as quiet, a is not null and b is not null as known,
  coalesce(case when b > a then 480 >= a and 480 < b else 480 >= a or 480 < b end, false) and a is not null and b is not null as on_ from m where duty_date is not null and upload_id is not null),
g as (select *, bool_or(quiet) over w as aq, bool_or(known) over w as ak from f window w as (partition by upload_id, duty_date))
select entry_id from g where case when aq then quiet when ak then on_ else true end""")
def active_entries(spark, d):
    """Entries in force at 08:00 of their day: no-coverage rows short-circuit, unknown windows fall back."""
    e = table(spark, d, "entry").where("duty_date is not null and upload_id is not null").select("entry_id", "upload_id", "duty_date", "name", clock_minute(F.col("starttime")).alias("a"), clock_minute(F.col("endtime")).alias("b"))
    quiet = F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit("no coverage"))
    return R.active_at(e, 480, "a", "b", ["upload_id", "duty_date"], quiet).select("entry_id")


def _case(x: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, '{m}')" + (f" and not regexp_matches({x}, '{e}')" if e else "") + f" then '{n}'" for n, m, e in LANES) + " end"


@query(f"""select specialty, {_case('lower(role)')} as lane, count(*) as n from entry group by all""")
def lane_classify(spark, d):
    """Roles classified by ordered patterns with exclusions."""
    return table(spark, d, "entry").groupBy("specialty", lane(F.col("role"), LANES).alias("lane")).agg(F.count("*").alias("n"))


@query(f"""with g as (select entry_id, phone is not null as k, bool_or(phone is not null) over (partition by upload_id, {_ROLE.format(x='role')}) as a from entry) select entry_id from g where k or not a""")
def keep_if_any(spark, d):
    """Rows with a phone, or all rows of an upload and role where none has one."""
    e = table(spark, d, "entry").select("entry_id", "upload_id", _role().alias("r"), "phone")
    return G.keep_if_any(e, ["upload_id", "r"], F.col("phone").isNotNull()).select("entry_id")


@query("""with t as (select doc_id, lower(text) as low, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' as padded from documents),
k as (select specialty, lower(unnest(keywords)) as word from specialty),
s as (select doc_id, specialty, sum(length(word)) as score from t, k where case when length(word) <= 3 and regexp_full_match(word, '[a-z0-9]+') then contains(padded, ' ' || word || ' ') else contains(padded, word) end group by all)
select doc_id, specialty, score, score < 6 as uncertain from (select *, row_number() over (partition by doc_id order by score desc, specialty) as n from s) where n = 1""")
def keyword_argmax(spark, d):
    """The specialty whose keywords a document names most, by summed length (I8)."""
    return S.detect(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "specialty"), "specialty", "keywords")


@query("""with p as (select specialty, lower(label) as l, list_transform(coalesce(keywords, []), lambda k: lower(k)) as ks from specialty where not coalesce(hidden, false)),
q as (select *, array_to_string(list_prepend(l, list_transform(ks, lambda k: trim(k))), ' ') as pool from p)
select specialty, case when l = 'care' then 0 when list_contains(ks, 'care') then 1 when starts_with(l, 'care') then 2 when contains(l, 'care') then 3 when len(list_filter(ks, lambda k: contains(k, 'care'))) > 0 then 4 else 5 end as rank from q where contains(pool, 'care')""")
def loose_match(spark, d):
    """Specialties that the query `care` finds, ranked."""
    return S.search(table(spark, d, "specialty"), "care", "label", "keywords", "hidden").select("specialty", "rank")


_INTENTS = (("imaging", ("mri", "scanner", "ultrasound"), ("imaging night",)), ("rota", ("rota", "locum"), ("standby line", "on call")), ("money", ("invoice", "payroll"), ()), ("course", ("exam", "lecture"), ("training pack",)))


@query("""with t as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' as p from documents)
select case when regexp_matches(p, ' (mri|scanner|ultrasound|imaging night) ') then 'imaging' when regexp_matches(p, ' (rota|locum|standby line|on call) ') then 'rota' when regexp_matches(p, ' (invoice|payroll) ') then 'money' when regexp_matches(p, ' (exam|lecture|training pack) ') then 'course' end as intent, count(*) as n from t group by 1""")
def intent_first(spark, d):
    """First intent rule that fits each text."""
    return table(spark, d, "documents").groupBy(S.intent(F.col("text"), _INTENTS).alias("intent")).agg(F.count("*").alias("n"))


@query(f"""with k as (select site_code, name, arg_max({phone('phone')}, contact_id) as p from contact where {phone('phone')} is not null group by all)
select entry_id, p as matched from entry e join k on e.site_code = k.site_code and e.name = k.name""")
def equi_contact_join(spark, d):
    """Entries with the phone of the contact of equal name at their site, the later contact winning."""
    c = table(spark, d, "contact").withColumn("p", clean_phone(F.col("phone"))).where("p is not null").groupBy("site_code", "name").agg(F.max_by("p", "contact_id").alias("matched"))
    return table(spark, d, "entry").select("entry_id", "site_code", "name").join(c, ["site_code", "name"]).select("entry_id", "matched")


@query(f"""with k as (select {canon('name')} as key, arg_max({phone('phone')}, contact_id) as p from contact where {phone('phone')} is not null and {canon('name')} <> '' group by 1)
select entry_id, p as matched_p from entry e left join k on {canon('e.name')} = k.key""")
def canonical_join(spark, d):
    """Entries with the phone of the contact of equal canonical name."""
    c = table(spark, d, "contact").select("contact_id", F.col("name").alias("n"), clean_phone(F.col("phone")).alias("p")).where("p is not null")
    return M.canonical_join(table(spark, d, "entry").select("entry_id", "name"), "name", c, "n", "p", "contact_id").select("entry_id", "matched_p")


@query()
def ladder_match(spark, d):
    """Entries resolved to one phone of their site by the first rule that is unambiguous, or by an initial."""
    c = table(spark, d, "contact").select("site_code", "name", clean_phone(F.col("phone")).alias("p"))
    return M.ladder(table(spark, d, "entry"), "entry_id", "name", ["site_code"], c, "name", "p")


@query(f"""with w as (select split_part({canon('name')}, ' ', 1) as word, {phone('phone')} as p from contact)
select word, count(distinct p) as phones, count(distinct p) > 1 as uncertain from w where p is not null and word <> '' group by word""")
def bare_names(spark, d):
    """First words of names and whether they lead to one phone."""
    return M.bare_names(table(spark, d, "contact").withColumn("p", clean_phone(F.col("phone"))), "name", "p")


@query(f"""select p, name as full_name from (select {phone('phone')} as p, name, row_number() over (partition by {phone('phone')} order by cast(lower(name) like 'dr%' as int) desc, length(name) desc, contact_id) as n from contact where {phone('phone')} is not null and name is not null) where n = 1""")
def name_of_phone(spark, d):
    """The fullest name known for each phone."""
    return M.name_of_phone(table(spark, d, "contact").withColumn("p", clean_phone(F.col("phone"))), "name", "p", "contact_id")


@query(f"""with c as (select string_split({canon('name')}, ' ') as w, {phone('phone')} as p from contact where {phone('phone')} is not null and name is not null),
h as (select k, min(p) as p, count(distinct p) as hits from (select unnest([array_to_string(w, ' '), w[1], w[-1]]) as k, p from c) where k <> '' group by k),
e as (select entry_id, string_split({canon('name')}, ' ') as w from entry where name is not null),
a as (select entry_id, unnest([array_to_string(w, ' '), w[1], w[-1]]) as k, unnest([0, 1, 2]) as pos from e),
f as (select entry_id, p, hits, row_number() over (partition by entry_id order by pos) as n from a join h using (k))
select entry_id, p, hits, hits = 1 as certain from f where n = 1""")
def indexed_keys(spark, d):
    """Entries matched by whole name, else first, else last word."""
    def keys(name: str):
        return let(F.split(canonical_name(F.col(name)), " "), lambda w: F.array(F.array_join(w, " "), F.element_at(w, 1), F.element_at(w, -1)))

    c = table(spark, d, "contact").where("name is not null").withColumn("p", clean_phone(F.col("phone"))).where("p is not null")
    return M.by_keys(table(spark, d, "entry").where("name is not null"), "entry_id", keys("name"), c, keys("name"), "p")


_STEPS = "steps as (select snap_no, lag(snap_no) over (order by snap_no) as prior from (select distinct snap_no from rota_snapshot where snap_no is not null))"


@query(f"""with {_STEPS}, s as (select snap_no, specialty, list_sort(list(coalesce(cast(record_id as varchar), '') || '|' || coalesce(created_at, '') || '|' || coalesce(pdf_url, ''))) as sig from rota_snapshot group by all),
a as (select t.snap_no, specialty, sig from s join steps t on s.snap_no = t.prior), b as (select s.* from s join steps t on s.snap_no = t.snap_no where prior is not null)
select coalesce(a.snap_no, b.snap_no) as snap_no, coalesce(a.specialty, b.specialty) as specialty, case when a.sig is null then 'added' when b.sig is null then 'removed' else 'changed' end as kind from a full join b on a.snap_no = b.snap_no and a.specialty = b.specialty where a.sig is distinct from b.sig""")
def signature_diffs(spark, d):
    """Specialties whose bag of records differs from each snapshot to the next."""
    old, new = consecutive(table(spark, d, "rota_snapshot"), "snap_no")
    return R.changed_groups(old, new, ["snap_no", "specialty"], F.col("record_id"), F.col("created_at"), F.col("pdf_url"))


@query("""select edit_id, min(upload_id) as upload_id from rota_edit e left join upload u on e.site_code = u.site_code and e.specialty = u.specialty and e.created_at >= u.uploaded_at and e.created_at < u.uploaded_at + interval 7 day group by edit_id""")
def interval_lookup(spark, d):
    """The first upload of its site and specialty in whose first week an edit falls."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    week = 7 * 86_400_000_000
    u = table(spark, d, "upload").select("site_code", "specialty", at("uploaded_at").alias("s"), (at("uploaded_at") + week).alias("e"), "upload_id", F.col("upload_id").alias("ord"))
    e = table(spark, d, "rota_edit").select("edit_id", "site_code", "specialty", at("created_at").alias("at"))
    return M.interval_join(e, "at", ["site_code", "specialty"], u, "s", "e", "ord", "upload_id", cell=week).select("edit_id", "upload_id")


@query(f"""with r as (select upload_id, list_sort(list_distinct(list({_ROLE.format(x='role')}))) as have from entry group by upload_id)
select upload_id, array_to_string(list_filter(have, lambda x: list_contains({list(ROLES)}, x)), ', ') as found, array_to_string(list_filter({sorted(ROLES)}, lambda x: not list_contains(have, x)), ', ') as missing from r""")
def missing_roles(spark, d):
    """Required roles each upload has and lacks."""
    out = Q.coverage(table(spark, d, "entry").withColumn("r", _role()), ["upload_id"], "r", ROLES)
    return out.select("upload_id", *[F.array_join(c, ", ").alias(c) for c in ("found", "missing")])


@query(f"""with r as (select contact_id, site_code, {canon('name')} as key, case source when 'manual' then 0 when 'server' then 1 else 2 end as priority from contact where name is not null)
select contact_id, priority from (select *, min(priority) over (partition by site_code, key) as best from r) where priority = best""")
def source_priority(spark, d):
    """Contacts of the most trusted source that knows a name at a site."""
    c = table(spark, d, "contact").where("name is not null").select("contact_id", "site_code", canonical_name(F.col("name")).alias("key"), "source")
    order = [c.where("source = 'manual'"), c.where("source = 'server'"), c.where("source is null or source not in ('manual', 'server')")]
    return R.by_priority(order, ["site_code", "key"]).select("contact_id", "priority")


@query(f"""with e as (select entry_id, upload_id, date_key, {_ROLE.format(x='role')} as r, coalesce(confidence, '') = 'high' as top from entry where upload_id is not null and date_key is not null and role is not null),
f as (select *, row_number() over (partition by upload_id, date_key, r order by entry_id) as n from e where not top and (upload_id, date_key, r) not in (select (upload_id, date_key, r) from e where top))
select entry_id from e where top union all select entry_id from f where n = 1""")
def schedule_merge(spark, d):
    """Rows of high confidence, and the first other row where a date and role has none."""
    e = table(spark, d, "entry").where("upload_id is not null and date_key is not null and role is not null").select("entry_id", "upload_id", "date_key", _role().alias("r"), (F.coalesce("confidence", F.lit("")) == "high").alias("top"))
    return R.merge_schedules(e.where("top"), e.where("not top"), ["upload_id", "date_key", "r"], F.asc("entry_id")).select("entry_id")


@query(f"""with s as (select entry_id, greatest(0, 100 - (case when name is null or trim(name) = '' then 50 else 0 end) - (case when {phone('phone')} is null then 25 else 0 end) - (case when coalesce(phoneuncertain, false) then 15 else 0 end) - (case when role is null then 20 else 0 end) - (case when duty_date is null then 20 else 0 end)) as score from entry)
select entry_id, score, case when score >= 75 then 'high' when score >= 45 then 'medium' else 'low' end as confidence from s""")
def row_confidence(spark, d):
    """Confidence of each row from penalties."""
    p = [(F.col("name").isNull() | (F.trim("name") == ""), 50), (clean_phone(F.col("phone")).isNull(), 25), (F.coalesce("phoneuncertain", F.lit(False)), 15), (F.col("role").isNull(), 20), (F.col("duty_date").isNull(), 20)]
    e = table(spark, d, "entry").select("entry_id", Q.penalty_score(p).alias("score"))
    return e.withColumn("confidence", Q.confidence(F.col("score")))


@query(f"""with {_STEPS}, n as (select snap_no, specialty, count(*) as n from rota_snapshot group by 1, 2)
select t.snap_no, a.specialty, a.n as before, coalesce(b.n, 0) as after, coalesce(b.n, 0) < 0.6 * a.n as loss from n a join steps t on a.snap_no = t.prior left join n b on b.snap_no = t.snap_no and a.specialty = b.specialty""")
def version_losses(spark, d):
    """Specialties that lost rows from each snapshot to the next (H8)."""
    old, new = consecutive(table(spark, d, "rota_snapshot"), "snap_no")
    return Q.version_loss(old, new, ["snap_no", "specialty"])


@query("""select site_code, duty_date, section, shift, count(*) as n from imaging group by all having count(*) > 1""")
def slot_cardinality(spark, d):
    """Imaging slots filled more than once."""
    return Q.crowded_slots(table(spark, d, "imaging"), ["site_code", "duty_date", "section", "shift"])


@query("""with h as (select site_code, duty_date, section, max(case when upper(shift) = 'AM' then nullif(trim(consultant), '') end) as am, max(case when upper(shift) = 'PM' then nullif(trim(consultant), '') end) as pm from imaging group by all)
select site_code, duty_date, section, am as consultant, case when pm is null or am = pm then '24h' else 'day' end as shift from h where am is not null
union all select site_code, duty_date, section, pm, 'night' from h where pm is not null and (am is null or am <> pm)""")
def half_days(spark, d):
    """Morning and evening rows merged to day, night and 24h rows."""
    return W.merge_halves(table(spark, d, "imaging"), ["site_code", "duty_date", "section"], "shift", "consultant")


@query("""select contact_id, name from contact where contains(lower(concat_ws(' ', name, specialty, phone)), 'care') order by contact_id limit 25 offset 25""")
def paged_search(spark, d):
    """Second page of a substring search over several columns."""
    hit = F.contains(F.lower(F.concat_ws(" ", "name", "specialty", "phone")), F.lit("care"))
    return G.page(table(spark, d, "contact").where(hit).select("contact_id", "name"), [F.asc("contact_id")], 2, 25)


@query("""with b as (select site_code, doctor, created_at, edit_id, role, phone from rota_edit where doctor is not null)
select site_code, doctor, edit_id, role from (select *, row_number() over (partition by site_code, doctor order by created_at desc nulls last, edit_id desc) as n from b) where n = 1""")
def upsert_latest(spark, d):
    """Edits merged into one row per person, newest winning."""
    e = table(spark, d, "rota_edit").where("doctor is not null").select("site_code", "doctor", "created_at", "edit_id", "role")
    early = F.col("edit_id") % 2 == 0  # the old state, and the changes that arrive: together all rows
    return K.upsert(e.where(early), e.where(~early), ["site_code", "doctor"], "created_at", "edit_id").select("site_code", "doctor", "edit_id", "role")


@query("""with n as (select lower(trim(doctor)) as key, arg_max(phone, edit_id) as phone from rota_edit where doctor is not null and phone is not null group by 1)
select manual_id, full_name, coalesce(n.phone, m.phone) as phone from manual_phone m left join n on lower(trim(m.full_name)) = n.key""")
def patch_nonnull(spark, d):
    """The phone list with phones from edits where there are any: nulls never overwrite."""
    e = table(spark, d, "rota_edit").where("doctor is not null and phone is not null").groupBy(F.lower(F.trim("doctor")).alias("key")).agg(F.max_by("phone", "edit_id").alias("phone"))
    m = table(spark, d, "manual_phone").select("manual_id", "full_name", "phone", F.lower(F.trim("full_name")).alias("key"))
    return K.patch(m, e, ["key"], ["phone"]).drop("key")


@query("""with n as (select max(created_at) as now from upload) select upload_id from upload, n where created_at + interval 30 day > now and status = 'success'""")
def ttl_cache(spark, d):
    """Uploads younger than 30 days at the newest upload's instant."""
    u = table(spark, d, "upload")
    both = u.crossJoin(F.broadcast(u.agg(F.max("created_at").alias("now")))).withColumn("expires", F.col("created_at") + F.expr("INTERVAL '30' DAY"))
    return K.fresh(both, F.col("now"), "expires", "status", "success").select("upload_id")


@query(f"""with {_STEPS}, o as (select * from (select *, row_number() over (partition by snap_no, record_id order by delivered_at desc, specialty, date_text nulls first, pdf_url nulls first) as n from rota_snapshot) where n = 1),
a as (select t.snap_no, record_id, specialty, date_text, pdf_url from o join steps t on o.snap_no = t.prior), b as (select o.* from o join steps t on o.snap_no = t.snap_no where prior is not null),
j as (select coalesce(a.snap_no, b.snap_no) as snap_no, coalesce(a.record_id, b.record_id) as record_id, a.record_id is null as is_new, b.record_id is null as is_gone, a.specialty as s0, b.specialty as s1, a.date_text as d0, b.date_text as d1, a.pdf_url as p0, b.pdf_url as p1 from a full join b on a.snap_no = b.snap_no and a.record_id = b.record_id)
select snap_no, record_id, 'add' as action, null::varchar as field, null::varchar as old_value, null::varchar as new_value from j where is_new
union all select snap_no, record_id, 'delete', null, null, null from j where is_gone
union all select snap_no, record_id, 'edit', 'specialty', s0, s1 from j where not is_new and not is_gone and s0 is distinct from s1
union all select snap_no, record_id, 'edit', 'date_text', d0, d1 from j where not is_new and not is_gone and d0 is distinct from d1
union all select snap_no, record_id, 'edit', 'pdf_url', p0, p1 from j where not is_new and not is_gone and p0 is distinct from p1""")
def audit_diffs(spark, d):
    """Change log from each snapshot to the next: one row per changed field."""
    one = lambda s: G.best_by(s, ["snap_no", "record_id"], F.desc("delivered_at"), F.asc("specialty"), F.asc_nulls_first("date_text"), F.asc_nulls_first("pdf_url"))
    old, new = consecutive(table(spark, d, "rota_snapshot"), "snap_no")
    return A.changes_log(one(old), one(new), ["snap_no", "record_id"], ["specialty", "date_text", "pdf_url"])


@query("""select event_type, count(*) as n, sum(cast(json_extract(props, '$.k') as bigint)) as k from events group by event_type""")
def json_props(spark, d):
    """Sums of a field of JSON text (K)."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(A.json_field(F.col("props"), "k", "bigint")).alias("k"))


@query("""select specialty, n, n * 100.0 / max(n) over () as share from (select specialty, count(*) as n from upload group by specialty)""")
def share_of_largest(spark, d):
    """Uploads per specialty in percent of the largest."""
    return G.share_of_largest(table(spark, d, "upload").groupBy("specialty").agg(F.count("*").alias("n")), "n")


@query("""with c as (select upload_id, count(*) as rows from entry group by 1)
select u.upload_id, coalesce(rows, 0) as rows, entries_count, case when coalesce(rows, 0) < 0.9 * entries_count then 'fail' when coalesce(rows, 0) > 1.1 * entries_count then 'warn' else 'ok' end as state from upload u left join c on u.upload_id = c.upload_id where entries_count is not null""")
def baseline_gate(spark, d):
    """Rows delivered against the count an upload announced."""
    base = table(spark, d, "upload").where("entries_count is not null").select("upload_id", "entries_count")
    return Q.against_baseline(table(spark, d, "entry"), ["upload_id"], base, "entries_count")


@query("""with r as (select *, role is not distinct from lag(role) over w and row_number() over w > 1 as same from rota_edit where doctor is not null window w as (partition by site_code, doctor order by created_at, edit_id)),
k as (select * from r where not same)
select edit_id, site_code, doctor, role, lead(created_at) over (partition by site_code, doctor order by created_at, edit_id) as valid_to from k""")
def role_history(spark, d):
    """Roles of a person over time, without repeats, each with its end."""
    e = table(spark, d, "rota_edit").where("doctor is not null").select("edit_id", "site_code", "doctor", "role", "created_at")
    return K.history(e, ["site_code", "doctor"], "created_at", [F.asc("created_at"), F.asc("edit_id")], ["role"]).select("edit_id", "site_code", "doctor", "role", "valid_to")


@query("""select upload_id, (row_number() over (partition by upload_id order by ord, entry_id) - 1) // 15 as batch, entry_id from entry""")
def row_batches(spark, d):
    """Rows of each upload in batches of 15."""
    e = table(spark, d, "entry").select("upload_id", "ord", "entry_id")
    return A.batches(e, ["upload_id"], [F.asc("ord"), F.asc("entry_id")], 15).select("upload_id", "batch", "entry_id")


@query("""select u.site_code, u.specialty, count(*) as n from upload u anti join (select distinct upload_id from entry where upload_id is not null) e on u.upload_id = e.upload_id group by all""")
def uploads_without_rows(spark, d):
    """Uploads of which no entry is left, per site and specialty."""
    gone = K.orphaned(table(spark, d, "upload"), table(spark, d, "entry").where("upload_id is not null"), "upload_id")
    return gone.groupBy("site_code", "specialty").agg(F.count("*").alias("n"))


@query("""select specialty, case when u > 0 then 'uploaded' when c > 0 then 'built_in' else 'none' end as state from (select s.specialty, (select count(*) from upload x where x.specialty = s.specialty and x.is_active) as u, (select count(*) from contact x where x.specialty = s.specialty) as c from specialty s)""")
def coverage_checklist(spark, d):
    """Whether each specialty is covered by an active upload, by contacts, or not at all."""
    count = lambda n, df: df.groupBy("specialty").agg(F.count("*").alias(n))
    s = table(spark, d, "specialty").select("specialty").join(count("u", table(spark, d, "upload").where("is_active")), "specialty", "left").join(count("c", table(spark, d, "contact")), "specialty", "left")
    return s.select("specialty", F.when(F.col("u") > 0, "uploaded").when(F.col("c") > 0, "built_in").otherwise("none").alias("state"))


@query("""select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n from events group by all""")
def click_stream_counts(spark, d):
    """Hourly counts of events read as a stream, each event once."""
    import uuid

    from watchbill.streaming.clicks import append, read_events, window_counts

    name = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/events-{name}"
    first = table(spark, d, "events").inputFiles()[0]
    folder, file = first.rsplit("/", 1)
    stream = read_events(spark, folder, "*.parquet" if folder.endswith("events.parquet") else file)
    append(stream.withColumn("ts", F.col("ts").cast("timestamp")), path, name).awaitTermination()
    # a whole table: events are made single after all have arrived, since a watermark would drop those of later files
    counts = window_counts(spark.read.parquet(path).dropDuplicates(["event_id"]), "ts", "event_type", "1 hour", "1 hour")
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
