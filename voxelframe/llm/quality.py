"""Quality rules with adaptive thresholds (operator 5), in DataFrame functions only.

The measures of each document that passes the base rules go into quantile
sketches per language and source: counts of log-linear buckets (the leading five
bits of the value), which add up when sketches merge, whatever the order. A
group's sketch is merged with those of its language and of all documents, each
scaled down to the weight of a few documents: a large group decides for itself,
a small one leans on its surroundings, and no size switches the rule. A fence
lies some spreads beyond a high quantile of that sketch; a document fails if a
measure lies beyond the fence of its own group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import lookup, saved

SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
BITS = 5  # leading bits that a bucket keeps: within 1/16 of the value
PRIOR_DOCS = 40  # documents that the language's sketch, and that of all documents, weigh in a group's at most
REACH = 4  # spreads beyond the quantile
HIGH, MIDDLE, LOW = 90, 50, 10  # percent: a fence is HIGH + REACH * (HIGH - MIDDLE), and likewise below; a spread is one bucket at least
#: Rates in thousandths: the count, what it is set against, and how many counted things may be chance, so that rounding in short texts decides nothing.
RATES = {"symbol_rate": ("n_symbols", "n_words", 3), "dup_line_rate": ("n_dup_lines", "n_lines", 3), "repeat_rate": ("n_repeat_words", "n_words", 12)}
MEASURES = (*RATES, "word_length")  # the last in hundredths of a code point, fenced on both sides


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the base counts of whole texts; null counts as empty. Narrow, nothing shuffles."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select("doc_id", "lang", "source", text.alias("t"))
    one = one.withColumn("w", F.array_remove(F.split("t", SPACES), ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_SPACE))
    n = F.size("w")
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    two = one.select(
        "doc_id",
        "lang",
        "source",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(n >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # hashes of three words in a row, told apart by 64 bits within one text
    m = F.greatest(F.size("h") - 2, F.lit(0))
    pair = F.zip_with(F.slice("h", F.lit(1), m), F.slice("h", F.lit(2), m), lambda a, b: F.xxhash64(a, b))
    three = two.withColumn("p", pair)
    three = three.withColumn("g", F.zip_with("p", F.slice("h", F.lit(3), F.size("p")), lambda a, b: F.xxhash64(a, b))).drop("p", "h")
    # only texts that repeat a window sort them; equal hashes then stand side by side
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ranked = F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    four = three.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), ranked).otherwise(none)).drop("g")
    rest = F.greatest(F.size("s") - 1, F.lit(0))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("s", F.lit(1), rest))
    twins = F.zip_with("s", before, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("twin")))
    again = F.zip_with(twins, F.slice("s", F.lit(2), rest), lambda a, b: F.when(a["twin"] | F.coalesce(a["h"] == b["h"], F.lit(False)), a["i"]))
    five = four.withColumn("at", F.array_sort(F.array_compact(again))).drop("s")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("at", zero, lambda acc, x: F.struct((x + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(acc["end"] - x, F.lit(0))).alias("n")), lambda acc: acc["n"])
    return five.select(
        *("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _measures(found: DataFrame) -> DataFrame:
    rate = lambda count, size: F.floor(F.col(count) * 1000 / F.greatest(size, F.lit(1)))
    return found.withColumns(
        {m: rate(count, size) for m, (count, size, _) in RATES.items()}
        | {"word_length": F.floor(F.col("word_chars") * 100 / F.greatest("n_words", F.lit(1))), "base_failed": _failed(), "g_lang": F.coalesce("lang", F.lit("")), "g_source": F.coalesce("source", F.lit(""))}
    )


def sketches(measured: DataFrame) -> DataFrame:
    """``(g_lang, g_source, measure, bucket, n)``: one mergeable sketch per group and measure. Aggregated before the shuffle."""
    long = measured.where("not base_failed").select("g_lang", "g_source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES))).alias("x")).select("g_lang", "g_source", "x.*")
    shifted = long.withColumn("shift", F.greatest(F.length(F.bin("v")) - BITS, F.lit(0)))
    return shifted.groupBy("g_lang", "g_source", "measure", F.expr("shiftleft(shiftright(v, shift), shift)").alias("bucket")).agg(F.count("*").alias("n"))


def _scaled(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merged over everything but ``keys``, and scaled down to :data:`PRIOR_DOCS` documents (in thousandths)."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = merged.groupBy(*keys, "measure").agg(F.sum("n").alias("total"))
    return merged.join(whole, [*keys, "measure"]).select(*keys, "measure", "bucket", F.expr(f"cast(cast(n as decimal(20,0)) * least(total, {PRIOR_DOCS}) * 1000 div total as bigint)").alias("w"))


def quantile(percent: int) -> Column:
    """Aggregate expression over a sketch with running weights ``upto`` and total ``all``: the bucket that holds the quantile."""
    return F.min(F.when(F.col("upto") * 100 >= F.col("all") * percent, F.col("bucket")))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Fences per language and source: ``(g_lang, g_source, <measure>_high, word_length_low)``."""
    names = ["g_lang", "g_source", "measure", "bucket", "w"]
    groups = sketch.select("g_lang", "g_source", "measure").distinct()
    own = sketch.select("g_lang", "g_source", "measure", "bucket", (F.col("n") * 1000).alias("w"))
    of_language = groups.join(_scaled(sketch, ["g_lang"]), ["g_lang", "measure"]).select(*names)
    of_all = groups.join(F.broadcast(_scaled(sketch, [])), "measure").select(*names)  # a bounded table: the buckets of four measures
    merged = own.union(of_language).union(of_all).groupBy("g_lang", "g_source", "measure", "bucket").agg(F.sum("w").alias("w"))
    part = Window.partitionBy("g_lang", "g_source", "measure")
    summed = merged.withColumn("upto", F.sum("w").over(part.orderBy("bucket"))).withColumn("all", F.sum("w").over(part))
    q = summed.groupBy("g_lang", "g_source", "measure").agg(quantile(LOW).alias("low"), quantile(MIDDLE).alias("middle"), quantile(HIGH).alias("high"))
    width = lambda c: F.expr(f"shiftleft(1L, greatest(length(bin({c})) - {BITS}, 0))")
    q = q.withColumn("up", F.col("high") + REACH * F.greatest(F.col("high") - F.col("middle"), width("high"))).withColumn("down", F.col("low") - REACH * F.greatest(F.col("middle") - F.col("low"), width("low")))
    at = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return q.groupBy("g_lang", "g_source").agg(*(at(m, "up").alias(f"{m}_high") for m in MEASURES), at("word_length", "down").alias("word_length_low"))


def quality(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, the base counts, ``base_failed`` and ``kept``.

    ``kept`` is false if the base rules fail, else true unless a measure lies
    beyond its group's fence. Empty and null texts have no words and fail. A null
    language or source counts as a group of its own; repeated rows each count;
    other columns are ignored.
    """
    found = saved(_measures(features(docs)), "quality")
    fences = saved(thresholds(sketches(found)), "fences")
    judged = lookup(found, fences, ["g_lang", "g_source"])
    inside = F.col("word_length").between(F.col("word_length_low"), F.col("word_length_high"))
    for m, (count, size, few) in RATES.items():
        inside = inside & (F.col(count) * 1000 <= F.col(f"{m}_high") * F.col(size) + few * 1000)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", *MEASURES)


_WS = "[ \x09-\x0D]+"
ORACLE_SQL = rf"""with d as (select row_number() over () rid, doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) lines from d),
tri as (select rid, unnest(range(1, len(w)-1)) i, unnest([w[k] || ' ' || w[k+1] || ' ' || w[k+2] for k in range(1, len(w)-1)]) g from w where len(w) >= 3),
twice as (select rid, i from tri qualify count(*) over (partition by rid, g) > 1),
cov as (select rid, count(distinct i + o) n from twice, (select unnest([0, 1, 2]) o) group by rid),
f as (select w.rid, doc_id, lang, source, cast(len(w) as bigint) n_words, cast(length(regexp_replace(t, '{_WS}', '', 'g')) as bigint) word_chars,
 cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(len(lines) as bigint) n_lines, cast(len(lines)-len(list_distinct(lines)) as bigint) n_dup_lines, cast(coalesce(cov.n, 0) as bigint) n_repeat_words
 from w left join cov on w.rid = cov.rid),
m as (select *, n_symbols*1000//greatest(n_words, 1) symbol_rate, n_dup_lines*1000//greatest(n_lines, 1) dup_line_rate, n_repeat_words*1000//greatest(n_words, 1) repeat_rate, word_chars*100//greatest(n_words, 1) word_length,
 n_words < {LEAST_WORDS} or 100*n_repeat_words > {MOST_REPEATED}*n_words base_failed from f),
ok as (select * from m where not base_failed),
l as (select lang, source, 'symbol_rate' measure, symbol_rate v from ok union all select lang, source, 'dup_line_rate', dup_line_rate from ok union all select lang, source, 'repeat_rate', repeat_rate from ok union all select lang, source, 'word_length', word_length from ok),
b as (select lang, source, measure, (v >> greatest(length(bin(v))-{BITS}, 0)) << greatest(length(bin(v))-{BITS}, 0) bucket, count(*) n from l group by all),
g as (select distinct lang, source, measure from b),
nl as (select lang, measure, bucket, sum(n) n from b group by all), na as (select measure, bucket, sum(n) n from b group by all),
bl as (select *, sum(n) over (partition by lang, measure) total from nl), ba as (select *, sum(n) over (partition by measure) total from na),
mg as (select lang, source, measure, bucket, n*1000 w from b union all select g.lang, source, measure, bucket, n*least(total, {PRIOR_DOCS})*1000//total from g join bl using (lang, measure) union all select lang, source, measure, bucket, n*least(total, {PRIOR_DOCS})*1000//total from g join ba using (measure)),
sm as (select lang, source, measure, bucket, cast(sum(w) as bigint) w from mg group by all),
up as (select *, sum(w) over (partition by lang, source, measure order by bucket) upto, sum(w) over (partition by lang, source, measure) al from sm),
q as (select lang, source, measure, min(bucket) filter (upto*100 >= al*{LOW}) q1, min(bucket) filter (upto*100 >= al*{MIDDLE}) q2, min(bucket) filter (upto*100 >= al*{HIGH}) q3 from up group by all),
fe as (select lang, source, measure, q3+{REACH}*greatest(q3-q2, 1 << greatest(length(bin(q3))-{BITS}, 0)) high, q1-{REACH}*greatest(q2-q1, 1 << greatest(length(bin(q1))-{BITS}, 0)) low from q),
bad as (select ok.rid, bool_or(case measure when 'symbol_rate' then n_symbols*1000 > high*n_words+{RATES['symbol_rate'][2]}*1000 when 'dup_line_rate' then n_dup_lines*1000 > high*n_lines+{RATES['dup_line_rate'][2]}*1000
 when 'repeat_rate' then n_repeat_words*1000 > high*n_words+{RATES['repeat_rate'][2]}*1000 else word_length > high or word_length < low end) bad from ok join fe using (lang, source) group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(bad, false) kept, n_lines, symbol_rate, dup_line_rate, repeat_rate, word_length from m left join bad using (rid)"""
