"""The query catalogue: each operator over the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as tx
from ..operators import corpus, groups, ledger, metrics, reader
from .. import tables
from . import views
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Register a query under its function's name, with its SQL over the named views."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *names) if names else sql
        return f

    return register


NORMAL = r"trim(regexp_replace(coalesce(text, ''), '[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]+', ' ', 'g'))"
COMPARABLE = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"
PAPER = "case when paper is null or paper = '' then null else case replace(upper(trim(paper)), ' ', '') when 'I' then 'P1' when '1' then 'P1' when 'II' then 'P2' when '2' then 'P2' when 'III' then 'P3' else replace(upper(trim(paper)), ' ', '') end end"
NUMBER = r"case when question_no is null or question_no = '' then null when regexp_matches(lower(question_no), '^\s*q?\s*(\d+)') then regexp_extract(lower(question_no), '^\s*q?\s*(\d+)\s*\(?\s*([a-z])?', 1) || regexp_extract(lower(question_no), '^\s*q?\s*(\d+)\s*\(?\s*([a-z])?', 2) else trim(lower(question_no)) end"
SCHOOL = "nullif(replace(upper(trim(school)), ' ', ''), '')"
TAG = f"case when {SCHOOL} is not null and year <> 0 and {PAPER} is not null and {NUMBER} is not null then {SCHOOL} || '|' || year || '|' || {PAPER} || '|' || {NUMBER} end"
KEY = rf"""case when school is not null or year is not null then 'paper|' || coalesce(school, '') || '|' || coalesce(cast(year as varchar), '') || '|' || coalesce({PAPER}, '') || '|'
  when source_file is not null and source_file <> '' then 'file||||' || source_file
  when contains(id, ':') then 'file||||' || regexp_replace(id, ':[^:]*$', '') else 'row||||' || id end"""


def flat_key(key: str = "key"):
    """A group key as one string, as the SQL has it."""
    return F.concat_ws("|", F.col(f"{key}.kind"), F.coalesce(f"{key}.school", F.lit("")), F.coalesce(F.col(f"{key}.year").cast("string"), F.lit("")), F.coalesce(f"{key}.paper", F.lit("")), F.coalesce(f"{key}.ref", F.lit("")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.with_group_key(views.corpus(spark, sf_dir))


# --- normalisation and provenance ----------------------------------------------------------


@query(f"select doc_id, md5({NORMAL}) as normal from documents")
def q01_normalise_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.normalise_question("text")).alias("normal"))


@query(f"select doc_id, md5({COMPARABLE}) as comparable from documents")
def q02_comparable_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.comparable_text("text")).alias("comparable"))


@query(f"select ord, {PAPER} as paper_norm, {NUMBER} as number_norm, {TAG} as tag from corpus", "corpus")
def q03_provenance_norm(spark, sf_dir):
    tag = tx.provenance_identity(F.col("school"), F.col("year"), F.col("paper"), F.col("question_no"))
    return views.corpus(spark, sf_dir).select("ord", tx.normalise_paper(F.col("paper")).alias("paper_norm"), tx.normalise_question_number(F.col("question_no")).alias("number_norm"), tag.alias("t")).select("ord", "paper_norm", "number_norm", F.when(F.col("t").isNotNull(), F.concat_ws("|", "t.school", F.col("t.year").cast("string"), "t.paper", "t.question")).alias("tag"))


@query(f"select ord, {KEY} as group_key from corpus", "corpus")
def q04_group_key(spark, sf_dir):
    return keyed(spark, sf_dir).select("ord", flat_key().alias("group_key"))


_HINTED = "select doc_id, case doc_id % 3 when 0 then 'tutorial_latex' when 1 then 'tutorial_pdf' else 'topical_bank' end as kind, 'tut:' || source || '-' || lang || ':q-' || doc_id as row_id from documents"


@query(f"select doc_id, case kind when 'tutorial_latex' then split_part(row_id, ':', 1) || ':' || split_part(row_id, ':', 2) when 'tutorial_pdf' then regexp_replace(row_id, '-[^-]*$', '') else row_id end as hint from ({_HINTED})")
def q05_grouping_hint(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "tutorial_latex").when(F.col("doc_id") % 3 == 1, "tutorial_pdf").otherwise("topical_bank")
    row_id = F.concat(F.lit("tut:"), "source", F.lit("-"), "lang", F.lit(":q-"), F.col("doc_id").cast("string"))
    return documents(spark, sf_dir).select("doc_id", tx.grouping_hint(kind, row_id).alias("hint"))


@query("""
select doc_id, case doc_id % 6 when 0 then 'apgp' when 1 then 'permutations-and-combinations' when 2 then 'curve-sketching' when 3 then 'differential-equations' when 4 then 'normal-distribution' end as chapter
from documents
""")
def q06_label_resolve(spark, sf_dir):
    spelling = F.element_at(F.array(*[F.lit(x) for x in ("APGP ", "PnC", "Curve_Sketching", " Differential Equations", "NORMAL DISTRIBUTION", "_snapshots")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return corpus.resolve_labels(documents(spark, sf_dir).select("doc_id", spelling.alias("folder")), "folder").select("doc_id", "chapter")


@query("""
select reason, count(*) as n from (
  select case when topic in ('Mathematical Induction', 'Binomial Thoerem') then topic
              when topic = 'Binomial & Poisson Distributions' and contains(lower(coalesce(text, '')), 'poisson') then 'Poisson' end as reason from corpus)
where reason is not null group by reason
""", "corpus")
def q07_filter_reasons(spark, sf_dir):
    return corpus.within_syllabus(views.corpus(spark, sf_dir))[1]


_FIRST = f"""
with tagged as (select *, {TAG} as tag from corpus),
first_pass as (select * from tagged qualify tag is null or row_number() over (partition by tag order by ord) = 1),
keyed_text as (select *, {COMPARABLE} as ct from first_pass),
second_pass as (select * from keyed_text qualify length(ct) < 40 or row_number() over (partition by ct order by ord) = 1)
"""


@query(_FIRST + "select id from first_pass", "corpus")
def q08_dedup_provenance(spark, sf_dir):
    return corpus.collapse_provenance(views.corpus(spark, sf_dir)).select("id")


@query(f"""
with k as (select doc_id as ord, {COMPARABLE} as ct from documents)
select ord from k qualify length(ct) < 40 or row_number() over (partition by ct order by ord) = 1
""")
def q09_dedup_text(spark, sf_dir):
    return corpus.collapse_text(documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), "text")).select("ord")


@query(_FIRST + "select (select count(*) from corpus) - (select count(*) from first_pass) as by_provenance, (select count(*) from first_pass) - (select count(*) from second_pass) as by_text", "corpus")
def q10_dedup_counts(spark, sf_dir):
    return corpus.collapse_duplicates(views.corpus(spark, sf_dir))[1]


@query("select class_id, slug, count(c.chapter) as n from langs left join corpus c on c.chapter = slug group by all", "corpus", "langs")
def q11_class_counts_with_zeros(spark, sf_dir):
    return corpus.counts_with_zeros(views.corpus(spark, sf_dir), views.langs(spark))


# --- groups and splits ---------------------------------------------------------------------

_KEYED = f"with k as (select *, {KEY} as group_key from corpus)"


@query(_KEYED + " select group_key, count(*) filter (where chapter = 'de') as de, count(*) filter (where chapter = 'en') as en, count(*) filter (where chapter = 'es') as es, count(*) filter (where chapter = 'fr') as fr from k group by group_key", "corpus")
def q12_group_class_matrix(spark, sf_dir):
    counts = groups.group_label_matrix(keyed(spark, sf_dir)).select(flat_key().alias("group_key"), "chapter", "n")
    return counts.groupBy("group_key").pivot("chapter", ["de", "en", "es", "fr"]).agg(F.sum("n")).fillna(0)


@query("""
with t as (select chapter, count(*) as total from corpus group by chapter), s as (select *, greatest(0.15e0 * total, least(5, total)::double) as test from t)
select chapter, total, round((total - test) * (0.70e0 / 0.85e0), 9) as train, round((total - test) * (1 - 0.70e0 / 0.85e0), 9) as val, round(test, 9) as test from s
""", "corpus")
def q13_class_targets(spark, sf_dir):
    return groups.targets(views.corpus(spark, sf_dir)).select("chapter", "total", *[F.round(c, 9).alias(c) for c in ("train", "val", "test")])


@query(_KEYED + """, per as (select group_key, chapter, count(*) as n, min(ord) as first_ord from k group by all),
pure as (select group_key, any_value(chapter) as chapter, any_value(n) as n, min(first_ord) as first_ord from per group by group_key having count(*) = 1),
best as (select * from pure qualify row_number() over (partition by chapter order by n desc, first_ord) = 1)
select b.chapter, b.group_key, b.n as block, t.total - b.n as scattered, b.n >= 5 and t.total - b.n < 7 as pinned
from best b join (select chapter, sum(n)::bigint as total from per group by chapter) t on b.chapter = t.chapter
""", "corpus")
def q14_pure_blocks(spark, sf_dir):
    return groups.pure_blocks(keyed(spark, sf_dir)).select("chapter", flat_key().alias("group_key"), "block", "scattered", "pinned")


@query(_KEYED + " select group_key, count(distinct split) as splits, count(*) as n, count(*) filter (where split = 'test') as test_rows from k group by group_key having count(distinct split) > 1", "corpus")
def q15_straddling_groups(spark, sf_dir):
    return groups.straddling(keyed(spark, sf_dir)).select(flat_key().alias("group_key"), "splits", "n", "test_rows")


@query("select 'lost' as side, id from corpus where quality = 0 union all select 'added' as side, id || '+' from corpus where quality = 1 and ord % 5 = 0", "corpus")
def q16_conservation(spark, sf_dir):
    before = views.corpus(spark, sf_dir).select("id", "ord", "quality")
    kept = before.where("quality is null or quality <> 0").select("id")
    added = before.where("quality = 1 and ord % 5 = 0").select(F.concat("id", F.lit("+")).alias("id"))
    return groups.lost_and_added(before, kept.unionByName(added))


@query(_KEYED + " select chapter, split, count(*) as n, count(distinct group_key) as groups, count(*) filter (where group_key like 'row|%') as ungroupable from k group by grouping sets ((split), (chapter, split), ())", "corpus")
def q17_split_summary(spark, sf_dir):
    return groups.split_summary(keyed(spark, sf_dir))


@query(f"with k as (select {KEY} as old_key, school || '|' || coalesce({PAPER}, '') as new_key from corpus where school is not null) select new_key, count(distinct old_key) as merged, count(*) as n from k group by new_key having count(distinct old_key) > 1", "corpus")
def q18_group_key_impact(spark, sf_dir):
    rows = keyed(spark, sf_dir).where("school is not null").select(flat_key().alias("old_key"), F.concat_ws("|", "school", F.coalesce(tx.normalise_paper(F.col("paper")), F.lit(""))).alias("new_key"))
    return groups.key_impact(rows)


@query(_KEYED + """, s as (select split, group_key, count(*) as n, md5('42:' || split || ':' || group_key) as h from k group by all),
o as (select *, coalesce(sum(n) over (partition by split order by h, group_key rows between unbounded preceding and 1 preceding), 0) as before,
      greatest(1, round_even(0.5e0 * sum(n) over (partition by split), 0)) as target from s)
select k.id, k.split from k join o on k.split = o.split and k.group_key = o.group_key where k.split = 'test' or o.before < o.target
""", "corpus")
def q19_subsample_groups(spark, sf_dir):
    return groups.subsample(keyed(spark, sf_dir), 0.5).select("id", "split")


# --- predictions ---------------------------------------------------------------------------


@query("select count(*) as n, count(*) filter (where y_true = predicted_a) as correct, avg((y_true = predicted_a)::int) as accuracy from pred", "pred")
def q20_accuracy(spark, sf_dir):
    return metrics.accuracy(views.pred(spark, sf_dir))


_PER_LABEL = """
with l as (select y_true as label from pred union select predicted_a from pred),
s as (select label, (select count(*) from pred where y_true = label) as support, (select count(*) from pred where predicted_a = label) as guessed,
      (select count(*) from pred where y_true = label and predicted_a = label) as hit from l),
f as (select label, support, case when guessed > 0 then hit / guessed else 0.0 end as precision, case when support > 0 then hit / support else 0.0 end as recall,
      case when support + guessed > 0 then 2 * hit / (support + guessed) else 0.0 end as f1 from s)
"""


@query(_PER_LABEL + "select round(avg(f1), 12) as macro_f1 from f", "pred")
def q21_macro_f1(spark, sf_dir):
    return metrics.macro_f1(views.pred(spark, sf_dir)).select(F.round("macro_f1", 12).alias("macro_f1"))


@query(_PER_LABEL + "select label, support, round(precision, 12) as precision, round(recall, 12) as recall, round(f1, 12) as f1 from f", "pred")
def q21_per_label(spark, sf_dir):
    return metrics.per_label(views.pred(spark, sf_dir)).select("label", "support", *[F.round(c, 12).alias(c) for c in ("precision", "recall", "f1")])


@query("select y_true, predicted_a as predicted, count(*) as n, min(ord) as first_ord from pred where y_true <> predicted_a group by all", "pred")
def q22_confusions(spark, sf_dir):
    return metrics.confusions(views.pred(spark, sf_dir))


@query("select a.slug as y_true, b.slug as predicted, count(p.ord) as n from langs a cross join langs b left join pred p on p.y_true = a.slug and p.predicted_a = b.slug group by all", "pred", "langs")
def q23_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(views.pred(spark, sf_dir), views.langs(spark))


def _wilson(k: str, n: str) -> str:
    z = "1.959964e0"
    centre, half = f"({k} / {n} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})", f"{z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n})"
    return f"round(greatest(0.0, {centre} - {half}), 9) as low, round(least(1.0, {centre} + {half}), 9) as high"


@query(f"with s as (select y_true as label, count(*) filter (where y_true = predicted_a)::double as k, count(*)::double as n from pred group by 1) select label, {_wilson('k', 'n')} from s", "pred")
def q24_wilson(spark, sf_dir):
    sums = views.pred(spark, sf_dir).groupBy(F.col("y_true").alias("label")).agg(F.count_if(F.col("y_true") == F.col("predicted")).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson_interval(F.col("k"), F.col("n"))
    return sums.select("label", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("select approach, fraction, count(value) as n, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0.0), 6) as stdev, min(value) as low, max(value) as high from ledger group by approach, fraction", "ledger")
def q25_spread(spark, sf_dir):
    return metrics.spread(views.ledger(spark, sf_dir), "value", "approach", "fraction").withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


_PAIRED = "count(*) filter (where predicted_a = y_true and predicted_b = y_true) as both_right, count(*) filter (where predicted_a = y_true and predicted_b <> y_true) as only_a, count(*) filter (where predicted_a <> y_true and predicted_b = y_true) as only_b, count(*) filter (where predicted_a <> y_true and predicted_b <> y_true) as both_wrong"


@query(f"select {_PAIRED} from pred", "pred")
def q26_paired_outcomes(spark, sf_dir):
    return metrics.paired_outcomes(views.pred(spark, sf_dir, "a"), views.pred(spark, sf_dir, "b"))


@query("""
with pairs as (select a as only_a, b as only_b, a + b as n, least(a, b) as k from (select cast(range as bigint) as a from range(0, 12)) cross join (select cast(range as bigint) as b from range(0, 12))),
logs as (select i, sum(case when i > 0 then ln(i) else 0 end) over (order by i) as lf from (select cast(range as bigint) as i from range(0, 40))),
tail as (select only_a, only_b, sum(exp(ln_n.lf - ln_j.lf - ln_r.lf - n * ln(2.0))) as t from pairs join range(0, 40) j on j.range <= k
         join logs ln_n on ln_n.i = n join logs ln_j on ln_j.i = j.range join logs ln_r on ln_r.i = n - j.range group by only_a, only_b)
select only_a, only_b, round(case when only_a + only_b = 0 then 1.0 else least(1.0, 2 * t) end, 9) as p from tail
""")
def q27_mcnemar(spark, sf_dir):
    side = lambda name: spark.range(12).select(F.col("id").alias(name))
    return stats.mcnemar(side("only_a").join(side("only_b"))).select("only_a", "only_b", F.round("p", 9).alias("p"))


@query(f"with c as (select {_PAIRED}, count(*)::double as n from pred), w as (select *, (only_a - only_b) / n as d, 1.959964e0 * sqrt(greatest(0.0, ((only_a + only_b) - (only_a - only_b) * (only_a - only_b) / n) / (n * n))) as h from c) select round(d - h, 9) as low, round(d + h, 9) as high from w", "pred")
def q28_paired_diff(spark, sf_dir):
    found = metrics.paired_outcomes(views.pred(spark, sf_dir, "a"), views.pred(spark, sf_dir, "b"))
    low, high = stats.paired_difference_interval(F.col("only_a"), F.col("only_b"), F.col("both_right") + F.col("only_a") + F.col("only_b") + F.col("both_wrong"))
    return found.select(F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"with s as (select y_true as label, count(*) filter (where y_true = predicted_a)::double as k, count(*)::double as n from pred group by 1), w as (select label, {_wilson('k', 'n')} from s) select a.label as first, b.label as second, a.low <= b.high and b.low <= a.high as meet from w a join w b on a.label < b.label", "pred")
def q29_overlap(spark, sf_dir):
    one = q24_wilson(spark, sf_dir)
    two = one.withColumnsRenamed({"label": "second", "low": "low2", "high": "high2"})
    return one.join(two, F.col("label") < F.col("second")).select(F.col("label").alias("first"), "second", stats.intervals_overlap(F.col("low"), F.col("high"), F.col("low2"), F.col("high2")).alias("meet"))


_SWEEP = """
with t as (select range * 5 / 100.0::double as threshold from range(0, 21)),
p as (select threshold, count(*) filter (where confidence >= threshold) as answered, count(*) as total, count(*) filter (where confidence >= threshold and y_true = predicted_a) as correct from t cross join pred group by threshold),
s as (select threshold, answered, total, answered / total as coverage, case when answered > 0 then correct / answered end as selective_accuracy, correct / total as full_accuracy from p)
"""


@query(_SWEEP + "select * from s", "pred")
def q30_sweep(spark, sf_dir):
    return metrics.sweep(views.pred(spark, sf_dir))


@query(_SWEEP + "select coalesce(min(threshold) filter (where selective_accuracy >= 0.9e0), 0.0) as cutoff from s", "pred")
def q31_select_cutoff(spark, sf_dir):
    return metrics.select_cutoff(metrics.sweep(views.pred(spark, sf_dir)), 0.9)


_BINS = """
with b as (select range as bin, range / 10.0::double as lower, (range + 1) / 10.0::double as upper from range(0, 10)),
r as (select bin, lower, upper, count(ord) as n, avg(confidence) as mean_confidence, avg((y_true = predicted_a)::int) as accuracy
      from b left join pred on confidence >= lower and (confidence < upper or (bin = 9 and confidence <= upper)) group by all)
"""


@query(_BINS + "select bin, lower, upper, n, round(mean_confidence, 9) as mean_confidence, round(accuracy, 9) as accuracy from r", "pred")
def q32_reliability(spark, sf_dir):
    return metrics.reliability(views.pred(spark, sf_dir)).withColumns({"mean_confidence": F.round("mean_confidence", 9), "accuracy": F.round("accuracy", 9)})


@query(_BINS + "select round(sum(n * abs(mean_confidence - accuracy)) / sum(n), 9) as mean_gap, round(sum(n * (mean_confidence - accuracy)) / sum(n), 9) as signed_gap from r where n > 0", "pred")
def q33_calibration_gap(spark, sf_dir):
    found = metrics.calibration_gap(metrics.reliability(views.pred(spark, sf_dir)))
    return found.select(F.round("mean_gap", 9).alias("mean_gap"), F.round("signed_gap", 9).alias("signed_gap"))


@query("select doc_id, class_id, score, rank from (select doc_id, class_id, (doc_id * (class_id + 3) * 7) % 13 as score, row_number() over (partition by doc_id order by (doc_id * (class_id + 3) * 7) % 13 desc, class_id desc) as rank from documents cross join langs) where rank <= 3", "langs")
def q34_topk_labels(spark, sf_dir):
    ranked = documents(spark, sf_dir).select("doc_id").join(F.broadcast(views.langs(spark)))
    scored = ranked.select("doc_id", F.col("class_id").cast("int").alias("class_id"), ((F.col("doc_id") * (F.col("class_id") + 3) * 7) % 13).alias("score"))
    return metrics.top_k(scored, 3, "doc_id")


_TOKENS = f"with t as (select doc_id, case when {NORMAL} = '' then 0 else len(string_split({NORMAL}, ' ')) end as tokens from documents)"


@query(_TOKENS + ", s as (select list_sort(list(tokens)) as a, count(*) as n from t) select share, a[greatest(least(round_even(share / 100.0::double * n, 0), n) - 1, 0)::int + 1] as value from s cross join (values (50), (90), (95), (99), (100)) v(share)")
def q35_percentiles(spark, sf_dir):
    return metrics.percentiles(documents(spark, sf_dir).select(tx.token_count(F.col("text")).alias("tokens")), "tokens", [50, 90, 95, 99, 100])


@query(_TOKENS + ' select "limit", count(*) filter (where tokens > "limit") as cut, count(*) filter (where tokens > "limit") / count(*) as share_cut, sum(greatest(tokens - "limit", 0))::bigint as lost, sum(greatest(tokens - "limit", 0)) / sum(tokens) as share_lost from t cross join (values (128), (256), (512), (1024)) v("limit") group by "limit"')
def q36_truncation_cost(spark, sf_dir):
    return metrics.truncation_cost(documents(spark, sf_dir).select(tx.token_count(F.col("text")).alias("tokens")), "tokens", [128, 256, 512, 1024])


@query("with n as (select chapter, count(*) as n from corpus group by chapter) select chapter, n, round(sum(n) over () / (count(*) over () * n), 9) as weight from n", "corpus")
def q37_class_weights(spark, sf_dir):
    return groups.class_weights(views.corpus(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


# --- the reader ----------------------------------------------------------------------------

_STRIP = r"regexp_replace(text, '^[\s\x{00A0}\x{000B}\x{0085}]+|[\s\x{00A0}\x{000B}\x{0085}]+$', '', 'g')"
_BODY = rf"""
with pages as (select paper_id, count(distinct page) as page_count from lines group by paper_id),
st as (select *, {_STRIP} as body from lines),
rep as (select paper_id, body, count(distinct page) as pages from st join pages using (paper_id) group by paper_id, body, page_count having length(body) >= 5 and count(distinct page) >= greatest(2, 0.5 * page_count)),
furn as (select st.*, body = '' or coalesce(size < 6.5, false) or regexp_matches(body, '\.{{15,}}') or y0 < 50 or y0 > page_height * 0.92e0 or exists (select 1 from rep where rep.paper_id = st.paper_id and rep.body = st.body) as furniture from st),
body as (select * from furn where not furniture),
col as (select paper_id, min(x0) as col from (select paper_id, x0 from body group by paper_id, x0 having count(*) >= 3) group by paper_id),
stops as (select paper_id, ord, page, y0 from body where regexp_matches(body, '(?i)^(Section\s+[A-Z]\b|BLANK PAGE|Additional page|Permission to reproduce items)')),
cand as (select b.paper_id, ord, page, y0, cast(regexp_extract(body, '(?s)^(\d{{1,2}})(?:[.)]\s*|\s+|$)(.*)$', 1) as int) as n, regexp_replace(regexp_extract(body, '(?s)^(\d{{1,2}})(?:[.)]\s*|\s+|$)(.*)$', 2), '^\s+|\s+$', '', 'g') as rest
         from body b join col using (paper_id) where abs(x0 - col) <= 2 and regexp_matches(body, '(?s)^(\d{{1,2}})(?:[.)]\s*|\s+|$)(.*)$') and not exists (select 1 from stops s where s.paper_id = b.paper_id and s.ord = b.ord)),
chain as (select paper_id, n as pos, min(ord) as ord from cand where n = 1 group by paper_id, n
          union all select c.paper_id, c.n, min(c.ord) over (partition by c.paper_id) from chain m join cand c on c.paper_id = m.paper_id and c.n = m.pos + 1 and c.ord > m.ord qualify row_number() over (partition by c.paper_id order by c.ord) = 1),
markers as (select c.paper_id, m.pos, c.ord, c.page, c.y0, c.rest from chain m join cand c on c.paper_id = m.paper_id and c.ord = m.ord),
cuts as (select *, case when row_number() over (partition by paper_id, page order by pos) = 1 and y0 < 842 * 0.12e0 then 0.0 else y0 - 6.0 end as cut_y from markers),
owned as (select b.paper_id, b.ord, b.page, b.y0, b.body, max(c.pos) as pos from body b join cuts c on c.paper_id = b.paper_id and (c.page < b.page or (c.page = b.page and c.cut_y <= b.y0)) group by all),
kept as (select o.*, m.ord as marker_ord from owned o join markers m on m.paper_id = o.paper_id and m.pos = o.pos
         where o.ord <> m.ord and not exists (select 1 from stops s where s.paper_id = o.paper_id and s.ord = o.ord)
         and not exists (select 1 from stops s where s.paper_id = o.paper_id and (s.page < o.page or (s.page = o.page and s.y0 <= o.y0)) and (s.page > m.page or (s.page = m.page and s.y0 > m.y0))))
"""
_READER = _BODY.replace("with pages as", "with recursive pages as", 1)


def page_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("paper_id").agg(F.count_distinct("page").alias("page_count"))


def body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.lines(spark, sf_dir)
    return reader.with_furniture(lines, page_counts(lines)).where("not furniture").drop("furniture")


def level_columns(body: DataFrame) -> DataFrame:
    return reader.question_column(body).select("paper_id", F.lit(0.0).alias("slope"), F.col("column").alias("intercept"))


@query(_READER + "select paper_id, body as text, pages from rep", "raw_lines", "lines")
def q38_repeated_lines(spark, sf_dir):
    lines = views.lines(spark, sf_dir)
    return reader.repeated_texts(lines, page_counts(lines))


@query(_READER + "select paper_id, ord, furniture from furn", "raw_lines", "lines")
def q39_furniture(spark, sf_dir):
    lines = views.lines(spark, sf_dir)
    return reader.with_furniture(lines, page_counts(lines)).select("paper_id", "ord", "furniture")


@query(_READER + 'select paper_id, col as "column" from col', "raw_lines", "lines")
def q40_column(spark, sf_dir):
    return reader.question_column(body_lines(spark, sf_dir))


@query(_READER + """, skewed as (select paper_id, ord, y0, x0 + 0.0122e0 * y0 as x0 from body), lft as (select paper_id, min(x0) as l from skewed group by paper_id),
band as (select s.* from skewed s join lft using (paper_id) where x0 <= l + 32), fit as (select paper_id, count(*) as n, regr_slope(x0, y0) as s, avg(x0) as mx, avg(y0) as my from band group by paper_id),
flat as (select paper_id, min(x0) as c from (select paper_id, x0 from skewed group by paper_id, x0 having count(*) >= 3) group by paper_id)
select f.paper_id, round(case when n >= 3 and not isnan(coalesce(s, 'nan'::double)) then s else 0.0 end, 6) as slope,
       round(case when n >= 3 then mx - (case when isnan(coalesce(s, 'nan'::double)) then 0.0 else s end) * my else c end, 4) as intercept from fit f left join flat using (paper_id)
""", "raw_lines", "lines")
def q41_skew_fit(spark, sf_dir):
    body = body_lines(spark, sf_dir).withColumn("x0", F.col("x0") + 0.0122 * F.col("y0"))
    return reader.skewed_column(body).select("paper_id", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


def marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    body = tables.written(body_lines(spark, sf_dir).select("paper_id", "ord", "page", "page_height", "x0", "y0", "body"), "body")
    return body, reader.find_markers(body, level_columns(body))


@query(_READER + "select paper_id, pos, ord from markers", "raw_lines", "lines")
def q42_markers(spark, sf_dir):
    return marked(spark, sf_dir)[1].select("paper_id", "pos", "ord")


@query(_READER + "select paper_id, ord, pos from owned", "raw_lines", "lines")
def q43_owner_asof(spark, sf_dir):
    body, markers = marked(spark, sf_dir)
    return reader.owners(body, reader.cut_points(markers, body)).select("paper_id", "ord", "pos")


@query(_READER + "select paper_id, ord, pos from kept", "raw_lines", "lines")
def q44_past_stop(spark, sf_dir):
    body, markers = marked(spark, sf_dir)
    return reader.before_stops(reader.owners(body, reader.cut_points(markers, body))).select("paper_id", "ord", "pos")


_QUESTIONS = _READER + """, parts as (select paper_id, pos, -1 as ord, page, rest as body from markers union all select paper_id, pos, ord, page, body from kept),
qs as (select paper_id, pos as number, min(page) filter (where ord = -1) as start_page, list_sort(list(distinct page)) as pages, coalesce(string_agg(body, ' ' order by ord) filter (where body <> ''), '') as text from parts group by paper_id, pos)
"""


@query(_QUESTIONS + "select paper_id, number, start_page, array_to_string(pages, ',') as pages, md5(text) as text from qs", "raw_lines", "lines")
def q45_questions(spark, sf_dir):
    lines = views.lines(spark, sf_dir)
    found, _ = reader.segment(lines, page_counts(lines))
    return found.select("paper_id", "number", "start_page", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.md5("text").alias("text"))


_RUNG = """
chars as (select p.paper_id, p.page, coalesce(sum(length(text)), 0) as chars from (select distinct paper_id, page from lines) p left join lines l on l.paper_id = p.paper_id and l.page = p.page group by all),
rung as (select paper_id, case when count(*) filter (where chars < 40) > 0.5 * count(*) then 2 else 1 end as rung, coalesce(array_to_string(list_sort(list(page) filter (where chars < 40)), ','), '') as scanned from chars group by paper_id)
"""


@query(_QUESTIONS + f""", {_RUNG.strip()}
select r.paper_id, rung, count(number) as questions, coalesce(max(number), 0) as highest_number, count(number) filter (where len(pages) > 4) as oversized, count(number) filter (where trim(text) = '') as empty,
  coalesce(array_to_string(list_filter(range(1, coalesce(max(number), 0) + 1), lambda n: not list_contains(list(number), n)), ','), '') as missing, count(number) - count(distinct number) as repeated,
  count(number) > 0 and count(number) filter (where len(pages) > 4 or trim(text) = '') = 0 as trustworthy
from rung r left join qs using (paper_id) group by r.paper_id, rung
""", "raw_lines", "lines")
def q46_reader_report(spark, sf_dir):
    lines = views.lines(spark, sf_dir)
    found, columns = reader.segment(lines, page_counts(lines))
    report = reader.reports(found, reader.rungs(reader.character_counts(lines, views.pages(spark, sf_dir))), columns)
    return report.select("paper_id", "rung", F.col("questions").cast("long").alias("questions"), "highest_number", F.size("oversized_questions").cast("long").alias("oversized"), F.size("empty_questions").cast("long").alias("empty"), F.array_join(F.col("missing_numbers").cast("array<string>"), ",").alias("missing"), F.size("duplicated_numbers").cast("long").alias("repeated"), "trustworthy")


@query(f"with {_RUNG.strip()} select paper_id, rung, scanned from rung", "raw_lines", "lines")
def q47_rung(spark, sf_dir):
    lines = views.lines(spark, sf_dir)
    return reader.rungs(reader.character_counts(lines, views.pages(spark, sf_dir))).select("paper_id", "rung", F.array_join(F.col("scanned").cast("array<string>"), ",").alias("scanned"))


_TRUTH = "select doc_id as paper_id, cast(n as int) as number, cast(n + doc_id % 2 as int) as start_page, [cast(n + doc_id % 2 as int)] as pages from documents cross join range(1, 4) r(n)"
_GUESS = "select doc_id as paper_id, cast(n as int) as number, cast(n + doc_id % 3 % 2 as int) as start_page, case when doc_id % 5 = 0 then [cast(n as int), cast(n + 1 as int)] else [cast(n + doc_id % 3 % 2 as int)] end as pages from documents cross join range(1, 5) r(n)"


@query(f"""
with t as ({_TRUTH}), g as ({_GUESS})
select * from (select count(*) as wanted, count(*) filter (where coalesce(g.start_page = t.start_page, false)) as found, count(*) filter (where coalesce(g.start_page = t.start_page and g.pages = t.pages, false)) as exact
  from t left join g on g.paper_id = t.paper_id and g.number = t.number)
cross join (select count(*) as spurious from g left join t on t.paper_id = g.paper_id and t.number = g.number and t.start_page = g.start_page where t.paper_id is null)
""")
def q48_truth_score(spark, sf_dir):
    ids = documents(spark, sf_dir).select(F.col("doc_id").alias("paper_id"))
    number = lambda last: ids.select("paper_id", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("number"))
    start = (F.col("number") + F.col("paper_id") % 2).cast("int")
    truth = number(3).select("paper_id", "number", start.alias("start_page"), F.array(start).alias("pages"))
    own = (F.col("number") + F.col("paper_id") % 3 % 2).cast("int")
    guess = number(4).select("paper_id", "number", F.col("number").cast("long").alias("ord"), own.alias("start_page"), F.when(F.col("paper_id") % 5 == 0, F.array(F.col("number"), F.col("number") + 1)).otherwise(F.array(own)).alias("pages"))
    return metrics.truth_score(truth, guess)


# --- the ledger ----------------------------------------------------------------------------


@query("select event_id, approach, seed, fraction, test_hash from ledger qualify row_number() over (partition by approach, seed, fraction, test_hash order by recorded desc, event_id desc) = 1", "ledger")
def q49_ledger_latest(spark, sf_dir):
    runs = views.ledger(spark, sf_dir).select("event_id", "approach", "seed", "fraction", "test_hash", "recorded")
    return ledger.latest(runs, "approach", "seed", "fraction", "test_hash").select("event_id", "approach", "seed", "fraction", "test_hash")


@query("select event_id from ledger where test_hash = 'new' and class_weights and max_tokens = 512 and abs(fraction - 0.5e0) < 1e-9", "ledger")
def q50_ledger_filter(spark, sf_dir):
    return ledger.comparable(views.ledger(spark, sf_dir), "new", {"class_weights": True, "max_tokens": 512}, 0.5).select("event_id")


@query("with p as (select approach, fraction, avg(correct / test_rows) as mean from ledger group by all) select approach, fraction, round(mean, 9) as mean, round(mean - lag(mean) over (partition by approach order by fraction), 9) as step from p", "ledger")
def q51_increments(spark, sf_dir):
    points = ledger.summary(views.ledger(spark, sf_dir), "approach", "fraction").select("approach", "fraction", "mean")
    return ledger.increments(points, "mean", "fraction", "approach").select("approach", "fraction", F.round("mean", 9).alias("mean"), F.round("step", 9).alias("step"))


# --- terms ---------------------------------------------------------------------------------

_TERMS = r"""
with w as (select doc_id, chapter, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}')) as term from (select doc_id, lang as chapter, text from documents)),
tf as (select doc_id, chapter, term, count(*) as n from w group by all), df as (select term, count(*) as df from tf group by term having count(*) >= 2),
x as (select doc_id, chapter, tf.term, (1 + ln(n)) * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as v from tf join df on df.term = tf.term),
u as (select doc_id, chapter, term, v / sqrt(sum(v * v) over (partition by doc_id)) as tfidf from x)
"""


def long_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..ml import features

    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("chapter"), "text")
    return features.long_tfidf(rows, "id")


@query(_TERMS + "select doc_id, term, round(tfidf, 6) as tfidf from u")
def q52_tfidf_long(spark, sf_dir):
    return long_tfidf(spark, sf_dir).select(F.col("id").alias("doc_id"), "term", F.round("tfidf", 6).alias("tfidf"))


@query(_TERMS + ", g as (select chapter, term, round(sum(tfidf), 4) as weight from u group by chapter, term), r as (select *, row_number() over (partition by chapter order by weight desc, term) as rank from g) select * from r where rank <= 12")
def q53_top_terms(spark, sf_dir):
    sums = long_tfidf(spark, sf_dir).groupBy("chapter", "term").agg(F.sum("tfidf").alias("weight"))
    order = Window.partitionBy("chapter").orderBy(F.round("weight", 4).desc(), "term")
    return sums.withColumn("rank", F.row_number().over(order)).where("rank <= 12").select("chapter", "term", F.round("weight", 4).alias("weight"), "rank")


@query("""
with n as (select conv_id, turn, cast((conv_id * 7 + turn * 5) % 4 + 1 as int) as number from conversations), l as (select *, lag(number) over (partition by conv_id order by turn) as before from n)
select conv_id, turn, number, sum(case when before is null or number <= before then 1 else 0 end) over (partition by conv_id order by turn)::bigint as section from l
""")
def q54_restart_sections(spark, sf_dir):
    from ..functions import pages

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    numbered = turns.select("conv_id", "turn", ((F.col("conv_id") * 7 + F.col("turn") * 5) % 4 + 1).cast("int").alias("number"))
    return pages.restart_sections(numbered, "conv_id", "turn", "number", "section")


@query("with c as (select *, min(turn) filter (where role = 'assistant' and length(text) > 1500) over (partition by conv_id) as cut from conversations) select conv_id, turn from c where cut is null or turn < cut")
def q55_take_prefix(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return corpus.take_until(turns, "conv_id", "turn", (F.col("role") == "assistant") & (F.char_length("text") > 1500)).select("conv_id", "turn")


# --- pages, marked-up text, checks, runs ---------------------------------------------------------

_PAGE_TEXT = "coalesce(text, '') || chr(10) || case doc_id % 4 when 0 then 'Answers' when 1 then 'Q1. ask' || chr(10) || 'Answers' when 2 then '[2013/Prelim/ABCJC/II/5]' || chr(10) || 'Level 2' else 'Level 3' end || chr(10) || repeat(chr(3), cast(doc_id % 6 as int))"
_TAG_LINE = r"^\s*\[\s*((?:[A-Z]{1,6}(?:\(JC\))?/)?(?:(?:Prelim|Pelim|Promo)\s*)?(?:19|20)\d{2}[ /][^\[\]]{0,55})\]\s*$"


@query(rf"""
with p as (select doc_id, {_PAGE_TEXT} as t from documents)
select doc_id, length(t) - length(replace(t, chr(3), '')) > 3 as solution,
  not regexp_matches(t, '(?m)^\s*Q(\d+)\.(.*)$') and not regexp_matches(t, '(?m){_TAG_LINE}') and regexp_matches(t, '(?m)^\s*(Level\s*[123]|Answers?)\s*$') as answers from p
""")
def q59_page_predicates(spark, sf_dir):
    text = F.expr(_PAGE_TEXT)
    return documents(spark, sf_dir).select("doc_id", text.alias("t")).select("doc_id", tx.is_solution_page(F.col("t")).alias("solution"), tx.is_answer_key_page(F.col("t")).alias("answers"))


_LATEX = r"'% note ' || lang || chr(10) || '\mk{' || cast(doc_id % 5 as varchar(9)) || '} 5\% \mk{2} \hfill\textbf{[' || cast(doc_id % 7 as varchar(9)) || ']} x % tail' || chr(10) || '[2013/Prelim/ABCJC/II/' || cast(doc_id % 9 as varchar(9)) || ']'"


@query(rf"""
with t as (select doc_id, {_LATEX} as x from documents)
select doc_id, regexp_replace(x, '(^|[^\\])%[^\n]*', '\1', 'g') as bare, list_sum(list_transform(regexp_extract_all(x, '\\mk\{{(\d+)\}}', 1), lambda n: cast(n as int)))::bigint as marks,
  regexp_replace(x, '\\hfill\\textbf\{{\[\d+\]\}}', ' ', 'g') as uncounted, trim(regexp_extract(x, '(?m){_TAG_LINE}', 1)) as tag from t
""")
def q60_tex_scalars(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.expr(_LATEX.replace("\\", "\\\\")).alias("x"))
    return rows.select("doc_id", tx.strip_comments(F.col("x")).alias("bare"), tx.marks(F.col("x")).cast("long").alias("marks"), tx.without_mark_counts(F.col("x")).alias("uncounted"), tx.first_provenance(F.col("x")).alias("tag"))


_IDS = "case when ord % 11 = 0 then '' when ord % 13 = 0 then null when ord % 7 = 0 then 'twice-' || cast(ord % 5 as varchar(9)) else id end"


@query(f"select id, count(*) as n from (select {_IDS} as id from corpus) group by id having count(*) > 1 or id is null or id = ''", "corpus")
def q61_bad_ids(spark, sf_dir):
    return corpus.bad_ids(views.corpus(spark, sf_dir).withColumn("id", F.expr(_IDS)))


@query("select distinct chapter from corpus where chapter not in ('de', 'en', 'it')", "corpus")
def q62_unknown_labels(spark, sf_dir):
    return corpus.unknown_labels(views.corpus(spark, sf_dir), views.langs(spark).where("slug in ('de', 'en', 'it')"))


@query("select count(*) filter (where c <> '') as labelled, count(*) filter (where c = '') as unlabelled from (select coalesce(case when ord % 4 = 0 then null when ord % 5 = 0 then '' else chapter end, '') as c from corpus)", "corpus")
def q63_labelled(spark, sf_dir):
    rows = views.corpus(spark, sf_dir).withColumn("chapter", F.expr("case when ord % 4 = 0 then null when ord % 5 = 0 then '' else chapter end"))
    counts = [side.agg(F.count("*").alias(name)) for side, name in zip(corpus.labelled(rows), ("labelled", "unlabelled"), strict=True)]
    return counts[0].join(counts[1])


@query("""
with n as (select class_id, slug, count(c.chapter) as n from langs left join corpus c on c.chapter = slug group by all)
select (select id from corpus order by length(coalesce(text, '')), ord limit 1) as shortest, (select id from corpus order by length(coalesce(text, '')) desc, ord limit 1) as longest,
  (select slug from n order by n.n, class_id limit 1) as thinnest, (select min(n.n) from n) as n
""", "corpus", "langs")
def q64_extremes(spark, sf_dir):
    rows = views.corpus(spark, sf_dir)
    return corpus.extremes(rows).join(corpus.thinnest(corpus.counts_with_zeros(rows, views.langs(spark))).withColumnRenamed("slug", "thinnest"))


@query("select token, count(*) as n from (select unnest(string_split(source || ' ' || lang || ' ' || cast(doc_id % 5 as varchar), ' ')) as token from documents) group by token")
def q65_bag_counts(spark, sf_dir):
    return corpus.bag_counts(documents(spark, sf_dir).select(F.split(F.concat_ws(" ", "source", "lang", (F.col("doc_id") % 5).cast("string")), " ").alias("bag")), "bag")


@query("""
with s as (select approach, fraction, count(*) as runs, avg(correct / test_rows) as mean, coalesce(stddev_samp(correct / test_rows), 0.0) as stdev, avg(correct) as k, max(test_rows)::double as n from ledger group by all),
w as (select *, k / n as p, 1.959964e0 * 1.959964e0 as zz from s), i as (select *, (p + zz / (2 * n)) / (1 + zz / n) as c, 1.959964e0 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n) as h from w)
select approach, fraction, runs, round(mean, 9) as mean, round(stdev, 9) as stdev, round(greatest(0.0, c - h), 9) as wilson_low, round(least(1.0, c + h), 9) as wilson_high from i
""", "ledger")
def q66_run_summary(spark, sf_dir):
    found = ledger.summary(views.ledger(spark, sf_dir), "approach", "fraction")
    return found.select("approach", "fraction", "runs", *[F.round(c, 9).alias(c) for c in ("mean", "stdev", "wilson_low", "wilson_high")])


@query("select paper_id, row_number() over (partition by paper_id order by page, round_even(y0, 0), x0, ord) - 1 as ord, page, md5(text) as text from (select paper_id, page, x0, y0 + ord % 2 / 2.0e0 as y0, ord, text from lines)", "raw_lines", "lines")
def q67_sorted_lines(spark, sf_dir):
    from ..sources import files

    rows = views.lines(spark, sf_dir).withColumn("y0", F.col("y0") + F.col("ord") % 2 / 2.0)
    return files.sorted_lines(rows).select("paper_id", "ord", "page", F.md5("text").alias("text"))


_BANK = r"case when ord % 10 = 3 then ' Q' || cast(ord as varchar(9)) || '. ask' when ord % 10 = 7 then 'Q' || cast(ord as varchar(9)) || '.' when ord % 4 = 1 then '[2013/Prelim/ABCJC/II/' || cast(ord as varchar(9)) || ']' else 'x' || cast(ord * 7 % 11 as varchar(9)) end"


@query(rf"""
with l as (select paper_id, ord, cast(floor(ord / 8.0) as int) as page, {_BANK} as line from raw_lines),
m as (select *, regexp_matches(line, '^\s*Q\d+\.') as mark, line like '[%' as tag, regexp_extract(line, '^\s*Q\d+\.(.*)$', 1) as rest from l),
c as (select *, count(*) filter (where mark) over (partition by paper_id order by ord) as marks from m),
t as (select *, count(*) filter (where tag) over (partition by paper_id, marks order by ord) as tags from c),
n as (select *, count(*) filter (where mark or (tag and marks > 0 and tags > 1)) over (partition by paper_id order by ord) as number from t)
select cast(paper_id as varchar) as source, cast(number as int) as number, min(page) as page, md5(coalesce(string_agg(case when not mark then line when trim(rest) <> '' then rest end, chr(10) order by ord), '')) as body,
  coalesce(trim(arg_min(line, ord) filter (where tag), '[]'), '') as tag from n where number > 0 group by paper_id, number
""", "raw_lines")
def q68_bank_runs(spark, sf_dir):
    from ..operators import books

    lines = views.lines(spark, sf_dir).select(F.col("paper_id").cast("string").alias("source"), "page", "ord").withColumn("line", F.expr(_BANK))
    pages = lines.groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("x")).select("source", "page", F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("text"))
    return books.bank_runs(pages).select("source", "number", "page", F.md5("body").alias("body"), F.coalesce("tag", F.lit("")).alias("tag"))


@query("select ord, coalesce(a.school, c.school) as school from corpus c left join (values ('SRC0', 'FIRST'), ('SRC1', 'FIRST')) a(alias, school) on c.school = a.alias", "corpus")
def q69_school_fold(spark, sf_dir):
    aliases = spark.createDataFrame([("SRC0", "FIRST"), ("SRC1", "FIRST")], "alias string, school string")
    return groups.fold_schools(views.corpus(spark, sf_dir), aliases).select("ord", "school")


_ANSWERS = "select 'one' as approach, f.fraction, s.seed, ord, y_true, case when (ord + s.seed) % 3 = 0 and f.fraction > 0.6e0 then predicted_b else predicted_a end as predicted from pred cross join (values (0.25e0), (0.5e0), (1.0e0)) f(fraction) cross join (values (42), (43), (44)) s(seed) where not (f.fraction = 0.5e0 and s.seed = 44)"


def answers(spark, sf_dir):
    a, b = (views.pred(spark, sf_dir, side).select("ord", "y_true", F.col("predicted").alias(f"predicted_{side}")) for side in "ab")
    return spark.sql(_ANSWERS.replace("from pred", "from {both}"), both=a.join(b.drop("y_true"), "ord"))


@query(f"""
with x as ({_ANSWERS}), j as (select a.seed, coalesce(a.predicted = a.y_true, false) as ra, coalesce(b.predicted = b.y_true, false) as rb from x a join x b on a.seed = b.seed and a.ord = b.ord where a.fraction = 0.5e0 and b.fraction = 1.0e0)
select 'one' as approach, seed, count(*) filter (where ra and rb) as "both", count(*) filter (where ra and not rb) as only_a, count(*) filter (where rb and not ra) as only_b, count(*) filter (where not ra and not rb) as neither,
  round((count(*) filter (where rb and not ra) - count(*) filter (where ra and not rb)) / count(*)::double, 9) as difference, 0.5e0 as earlier, 1.0e0 as later from j group by seed
""", "pred")
def q70_last_step(spark, sf_dir):
    return ledger.last_step(answers(spark, sf_dir)).select("approach", "seed", "both", "only_a", "only_b", "neither", F.round("difference", 9).alias("difference"), "earlier", "later")


_FAULTY = "select case when ord % 17 = 0 then '' when ord % 19 = 0 then 'same' else id end as id, case when ord % 23 = 0 then 'none' when ord % 29 = 0 then null else chapter end as chapter, case when ord % 31 = 0 then '  ' else text end as text, case when ord % 37 = 0 then '\\Sol x' else text end as raw_text, source from corpus"


@query(rf"""
with r as ({_FAULTY})
select id, 'no id' as fault from r where id = '' union all select id, 'unknown label' from r where coalesce(chapter, '') not in ('', 'de', 'en', 'es', 'fr', 'it')
union all select id, 'no text' from r where trim(coalesce(text, '')) = '' union all select id, 'solution marks' from r where contains(coalesce(raw_text, ''), '\Sol')
union all select id, 'repeated id' from r where id <> '' group by id having count(*) > 1
""", "corpus")
def q71_row_faults(spark, sf_dir):
    rows = spark.sql(_FAULTY.replace("\\", "\\\\").replace("from corpus", "from {rows}"), rows=views.corpus(spark, sf_dir))
    return corpus.row_faults(rows, views.langs(spark))


@query("select source, count(*) as rows, count(distinct chapter) as labels, 0::bigint as unlabelled from corpus group by source", "corpus")
def q72_rows_by_source(spark, sf_dir):
    return corpus.rows_by_source(views.corpus(spark, sf_dir))


@query("select approach, fraction, array_to_string(list_sort(list(distinct seed)), ',') as seeds from ledger group by all", "ledger")
def q73_seed_coverage(spark, sf_dir):
    return ledger.seed_coverage(views.ledger(spark, sf_dir)).select("approach", "fraction", F.array_join(F.col("seeds").cast("array<string>"), ",").alias("seeds"))


@query("select y_true, predicted, n, first_ord, (select count(*) from (select 1 from pred where y_true <> predicted_a group by y_true, predicted_a having count(*) = 1)) as singles from (select y_true, predicted_a as predicted, count(*) as n, min(ord) as first_ord from pred where y_true <> predicted_a group by all having count(*) >= 2) order by n desc, first_ord limit 8", "pred")
def q74_worst_confusions(spark, sf_dir):
    return metrics.worst_confusions(views.pred(spark, sf_dir, "a"), 8, 2)


# --- without SQL: order-dependent choices, scans in Python, fitted models ----------------------


@query()
def q56_split_assignment(spark, sf_dir):
    from ..operators import split

    return split.split_rows(views.corpus(spark, sf_dir).drop("split"), labels=views.langs(spark)).select("id", "split")


@query()
def q57_latex_prose(spark, sf_dir):
    from ..functions import latex

    marked = F.concat(F.lit(r"\textbf{"), F.col("lang"), F.lit(r"} $\frac{1}{2} \le \pi$ % note "), F.lit("\n"), F.coalesce("text", F.lit("")))
    read = documents(spark, sf_dir).select("doc_id", latex.to_prose(marked).alias("p"))
    return read.select("doc_id", F.md5("p.text").alias("prose"), F.size("p.dropped").alias("dropped"))


@query()
def q58_classifier(spark, sf_dir):
    from ..ml import model

    rows = views.corpus(spark, sf_dir).select("ord", "chapter", F.coalesce("text", F.lit("")).alias("text"), "split")
    fitted = model.fit(rows.where("split <> 'test'"), 1.0)
    return fitted.transform(rows.where("split = 'test'")).select("ord", "chapter", "predicted")
