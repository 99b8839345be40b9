"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0) on a text. Expectation-
maximisation over the counts of vote patterns estimates, for every rule, how
often its votes are right on good and on bad texts, and the share of good texts;
a text is kept if its posterior probability of being good is at least a half.
The model is fitted on the texts that pass the base conditions, as the others are
rejected anyway; what is left to tell apart are the kinds of junk that these miss.
No two rules read the same signal, as votes count as independent. A kind of junk
that only one rule sees is told from an error of that rule by the floor of
accuracy on good texts: rules are written so that their bad votes are rarely wrong.
There are at most 3**rules patterns however large the corpus is, so the
iterations run inside one row of one task, and the posteriors join back by
pattern as a table of that bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.rows import text_hash, without
from driftwood.sources.workspace import written

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ITERATIONS = 25
#: Where EM starts: share of good texts, accuracy of votes on good texts and on bad ones (most rules pass most junk).
START = (0.9, 0.99, 0.3)
#: What a share may be, and the least accuracy on good texts: of a rule's votes on these at most one in a hundred is bad.
SHARE, FLOOR = (0.02, 0.999), 0.99


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


#: Name and vote of each rule, over the columns of ``measured``. Ratios are written as products: no division by 0.
RULES: dict[str, Column] = {}


def _rules() -> dict[str, Column]:
    if not RULES:
        c = F.col
        RULES["length"] = _vote(c("n_words") < 10, c("n_words") >= 50)
        RULES["symbols"] = _vote(c("n_symbols") * 20 > c("word_chars"), c("n_symbols") * 100 <= c("word_chars"))
        RULES["line_repeats"] = _vote(c("n_dup_lines") * 10 > c("n_text_lines") * 3, (c("n_dup_lines") == 0) & (c("n_text_lines") > 1))
        RULES["word_repeats"] = _vote(c("n_repeat_words") * 5 > c("n_words"), c("n_repeat_words") * 20 <= c("n_words"))
        RULES["capitals"] = _vote(c("n_upper") * 5 > c("word_chars") * 2, c("n_upper") * 5 <= c("word_chars"))
        RULES["word_length"] = _vote((c("word_chars") < c("n_words") * 2) | (c("word_chars") > c("n_words") * 14), (c("word_chars") >= c("n_words") * 3) & (c("word_chars") <= c("n_words") * 10))
        RULES["exclamations"] = _vote(c("n_exclaims") * 4 > c("n_words"), c("n_exclaims") * 20 <= c("n_words"))
        RULES["vocabulary"] = _vote((c("n_distinct") * 5 < c("n_words")) & c("n_words").between(50, 2000), c("n_distinct") * 5 >= c("n_words") * 2)
    return RULES


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the measures of each text that the rules read. A null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # one pass leaves the counted characters only; a translate over whole texts costs many times that
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", text_hash().alias("text_hash"),
        F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+", -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))).alias("lines"),
        F.regexp_replace("text", "[^A-Z!#*$%&|<>]+", "").alias("marks"),
    )
    less = lambda chars: F.length("marks") - F.length(F.translate("marks", chars, ""))
    base = base.withColumns({"word_chars": F.length(F.array_join("words", "")), "n_symbols": less(SYMBOLS), "n_upper": less(UPPER), "n_exclaims": less("!")}).drop("marks")
    n = F.size("words")
    # equal windows have equal hashes: only a text with an equal pair of hashes can repeat a window
    hashes = F.transform(F.slice("words", 1, F.greatest(n - 4, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, 5))))
    base = base.select(
        "*", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_text_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.array_distinct(hashes)).alias("n_hashes"),
    ).drop("lines")
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.struct(F.array_join(F.slice("words", i + 1, 5), " ").alias("w"), i.alias("i")))
    base = base.withColumn("sorted", F.when(F.col("n_hashes") < n - 4, F.sort_array(windows))).drop("words", "n_hashes")
    near = lambda x, j: (F.get("sorted", j - 1)["w"] == x["w"]) | (F.get("sorted", j + 1)["w"] == x["w"])
    repeated = F.sort_array(F.transform(F.filter("sorted", near), lambda x: x["i"]))
    covered = F.aggregate(
        "repeated", F.struct(F.lit(0).alias("end"), F.lit(0).alias("words")),
        lambda a, i: F.struct((i + 5).alias("end"), (a["words"] + i + 5 - F.greatest(a["end"], i)).alias("words")),
        lambda a: a["words"],
    )
    base = base.withColumn("repeated", repeated).drop("sorted").withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("repeated")
    return base.withColumns({x: F.col(x).cast("long") for x in ("word_chars", "n_symbols", "n_upper", "n_exclaims")})


def _posteriors(patterns: DataFrame, rules: int) -> DataFrame:
    """(pattern, posterior) from (pattern, n), by EM within one row."""
    low, high = SHARE
    start = ", ".join(f"{x}D" for x in START)
    total = lambda what: f"aggregate(sequence(0, size(p) - 1), 0D, (s, i) -> s + p[i].n * {what})"
    rate = lambda right, voted, least=low: f"least({high}D, greatest({least}D, ({total(right)} + 1D) / ({total(voted)} + 2D)))"
    good, bad = [], []
    for j in range(rules):
        vote = f"p[i].v[{j}]"
        good.append(rate(f"IF({vote} = 1, q[i], 0D)", f"IF({vote} <> 0, q[i], 0D)", FLOOR))
        bad.append(rate(f"IF({vote} = -1, 1D - q[i], 0D)", f"IF({vote} <> 0, 1D - q[i], 0D)"))
    score = (
        f"aggregate(sequence(0, {rules - 1}), ln(m.pi / (1D - m.pi)), (s, j) -> s + CASE x.v[j] "
        "WHEN 1 THEN ln(m.good[j] / (1D - m.bad[j])) WHEN -1 THEN ln((1D - m.good[j]) / m.bad[j]) ELSE 0D END)"
    )
    guess = f"transform(p, x -> 1D / (1D + exp(-{score})))"
    model = f"named_struct('pi', least({high}D, greatest({low}D, ({total('q[i]')} + 1D) / ({total('1D')} + 2D))), 'good', array({', '.join(good)}), 'bad', array({', '.join(bad)}))"
    first_model = "named_struct('pi', {0}, 'good', array_repeat({1}, {n}), 'bad', array_repeat({2}, {n}))".format(*start.split(", "), n=rules)
    step = f"aggregate(sequence(1, {ITERATIONS}), transform(array({first_model}), m -> {guess})[0], (q, t) -> transform(array({model}), m -> {guess})[0])"
    votes = f"transform(sequence(0, {rules - 1}), j -> cast(pmod(cast(floor(pattern / power(3, j)) as int), 3) - 1 as int))"
    # one row of at most 3**rules patterns
    one = patterns.groupBy().agg(F.sort_array(F.collect_list(F.expr(f"named_struct('pattern', pattern, 'v', {votes}, 'n', cast(n as double))"))).alias("p"))
    one = one.where("size(p) > 0").select("p", F.expr(step).alias("q"))
    return one.select(F.explode(F.arrays_zip("p", "q")).alias("x")).select(F.col("x.p.pattern").alias("pattern"), F.col("x.q").alias("posterior"))


def quality(docs: DataFrame) -> DataFrame:
    """The measures of each text, its posterior quality, and whether it is kept.

    docs: ``doc_id`` bigint and ``text``; other columns are ignored. Words are
    runs of [^\\x20\\x09-\\x0D]. Returns doc_id, text_hash, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words (words inside windows of five words
    that the text has twice or more), base_failed (fewer than 10 words, or more
    than a fifth of the words repeat), posterior, and kept (not base_failed and
    a posterior of at least 0.5; that is null if no text that passed the base
    conditions has the same votes). Null and empty texts have no words and fail.
    Every row has its result, repeated rows too; an empty table gives none. A
    posterior of exactly 0.5 keeps. A very long text is one row's arrays of words.
    """
    rules = _rules()
    code = sum(((vote + 1) * 3**j for j, vote in enumerate(rules.values())), F.lit(0))
    rows = written(measured(docs).withColumn("pattern", code.cast("int")), "quality")
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    posteriors = _posteriors(rows.where(~base_failed).groupBy("pattern").agg(F.count("*").alias("n")), len(rules))
    kept = ~base_failed & (F.coalesce("posterior", F.lit(0.0)) >= 0.5)
    return rows.join(F.broadcast(posteriors), "pattern", "left").select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), "posterior", kept.alias("kept"),
    )


def quality_filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that ``quality`` keeps."""
    gone = written(quality(docs).where("not kept").select("doc_id", "text_hash").distinct(), "rejected")
    return without(docs, gone, gone.count())
