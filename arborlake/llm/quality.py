"""Quality rules with risk-controlled thresholds.

Each rule compares one statistic of a text with a cutoff; a text is rejected if it fails any rule. For
every stratum (language), a labelled holdout decides how strict the rules are, so that few good documents
are rejected: good documents of one lot of the holdout propose a path of settings, from mild to strict, and
those of the other lots prove them. A setting is proved if the exact binomial tail P(Bin(n, risk) <=
false rejections), the p-value for "all rules together reject more than the risk" (equal to a
Clopper-Pearson bound), is at most the level. Along the path settings are tested one after the other at
the full level, up to the first that fails (fixed-sequence testing), and strata share the error budget
by Bonferroni's correction. So with probability 1 - delta the chosen settings of all strata reject at most
``risk`` of the good documents of their stratum, each.

Everything is one DataFrame plan: statistics, path, tails, selection and verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.common import blank_words, free_name, let, small_table, written

#: The symbols that the base statistics count.
SYMBOLS = "#*$%&|<>"
#: Rule -> (numerator, denominator, cutoffs from mild to strict); a text fails a rule when
#: numerator > cutoff * denominator.
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("n_symbols", "n_words", [1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02]),
    "repeats": ("n_repeat_words", "n_words", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "lines": ("n_dup_lines", "n_lines", [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]),
    "long_words": ("word_chars", "n_words", [40.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0]),
    "short_words": ("n_words", "word_chars", [0.9, 0.7, 0.5, 0.4, 0.35, 0.3, 0.27, 0.25]),
}
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: The path, as (share, back): a rule's cutoff lies ``back`` places before the strictest one that rejects at
#: most this share of the proposing lot.
PATH = [(0.0, 3), (0.0, 2), (0.0, 1), (0.0, 0), (0.002, 0), (0.004, 0), (0.006, 0), (0.01, 0), (0.015, 0), (0.02, 0)]
#: A document proposes if the first hex digit of its id's MD5 is below this; a quarter do.
PROPOSING = "4"
#: Bits of a sort key that hold a word's place; longer texts take the plain way.
PLACE_BITS = 22


def _repeat_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. A window's sort key is its hash' leading bits with its
    place behind, so that an array of longs is sorted; where two windows agree in those bits but
    not in the hash, or the text is too long for them, pairs of (hash, place) are sorted instead.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    mask = (1 << PLACE_BITS) - 1

    def by_keys(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))

        def places(k: Column) -> Column:
            lead = lambda j: F.shiftright(F.get(k, j), PLACE_BITS)
            at = lambda j: F.get(k, j).bitwiseAND(F.lit(mask)).cast("int")
            alike = lambda j, o: F.coalesce(lead(j) == lead(o), F.lit(False))
            twins = F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda j: alike(j, j - 1) | alike(j, j + 1))
            clash = lambda js: F.exists(js, lambda j: alike(j, j + 1) & (F.get(h, at(j)) != F.get(h, at(j + 1))))
            return let(twins, lambda js: F.when(clash(js), by_pairs(h)).otherwise(F.sort_array(F.transform(js, lambda j: at(j)))))

        return let(keys, places)

    def by_pairs(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("at"))))
        same = lambda p, j, o: F.coalesce(F.get(p, j)["h"] == F.get(p, o)["h"], F.lit(False))
        return let(pairs, lambda p: F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: same(p, j, j - 1) | same(p, j, j + 1)), lambda j: F.get(p, j)["at"])))

    found = let(hashes, lambda h: F.when(F.size(h) <= mask, by_keys(h)).otherwise(by_pairs(h)))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(found, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(covered)


def text_statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a word),
    ``n_dup_lines`` and ``n_repeat_words``; existing columns of those names are replaced. Null and
    empty texts have zeros."""
    docs = docs.drop(*STATISTICS)
    words, lines, text = free_name(docs, "words", "lines", "plain")
    plain = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.filter(F.split(plain, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    # The symbols are counted in the words: the two agree, as no symbol is white space.
    return (
        docs.withColumn(text, plain)
        .withColumn(words, blank_words(F.col(text_col)))
        .withColumn(lines, trimmed)
        .select(
            *docs.columns,
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
            (F.char_length(text) - F.char_length(_without(F.col(text), SYMBOLS))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            let(F.col(words), _repeat_words).alias("n_repeat_words"),
        )
    )


def _without(text: Column, letters: str) -> Column:
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to rounding, for k below n * p; 1 from there on.

    The logarithm of the largest term is a sum over 1..k, the other terms follow by ratio.
    """
    import math

    q = 1 - p
    k, n = k.cast("int"), n.cast("double")
    upto = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    log_top = F.aggregate(upto, F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i)) + k * math.log(p) + (n - k) * math.log(q)
    down = F.reverse(upto)
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * i / (n - i + 1) * (q / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    tail = F.exp(log_top) * F.aggregate(down, state, step, lambda a: a["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def proposed_path(proposing: DataFrame, stratum: str) -> DataFrame:
    """(stratum, path): for every entry of PATH a struct of cutoffs by rule, null where even the mildest
    cutoff rejects too many. ``proposing`` has good documents alone, with their statistics."""
    grid = [(r, c) for r, (_, _, cs) in RULES.items() for c in cs]
    counts = [F.sum(_fails(r, F.lit(c)).cast("long")).alias(f"r{j}") for j, (r, c) in enumerate(grid)]
    wide = proposing.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *counts)
    settings = []
    for share, back in PATH:
        cutoffs = []
        for rule, (_, _, values) in RULES.items():
            # Cutoffs go from mild to strict and their counts never fall: those that fit come first.
            fits = [(F.col(f"r{j}") <= F.floor(F.lit(share) * F.col("n"))).cast("int") for j, (r, _) in enumerate(grid) if r == rule]
            cutoffs.append(F.get(F.array(*map(F.lit, values)), sum(fits[1:], fits[0]) - 1 - back).alias(rule))
        settings.append(F.struct(*cutoffs))
    return wide.select("stratum", F.array(*settings).alias("path"))


def select_cutoffs(holdout: DataFrame, stratum: str, *, proposes: Column, strata: list[str], risk: float = 0.03, delta: float = 0.05) -> DataFrame:
    """(stratum, step, n, rejected, p_value, cutoffs): of each stratum the last setting that is proved, none
    where there are too few good documents to prove the first. ``holdout`` has good documents alone."""
    own = F.col(stratum)
    path = proposed_path(holdout.where(proposes), stratum)
    proving = holdout.where(~proposes).join(F.broadcast(path.withColumnRenamed("stratum", "own")), own == F.col("own"))
    counts = [F.sum(_fails_any(F.get("path", j)).cast("long")).alias(f"k{j}") for j in range(len(PATH))]
    tested = proving.groupBy(own.alias("stratum"), "path").agg(F.count("*").alias("n"), *counts)
    steps = F.array(*[F.struct(F.lit(j).alias("step"), F.col(f"k{j}").alias("rejected"), F.get("path", j).alias("cutoffs")) for j in range(len(PATH))])
    tested = tested.select("stratum", "n", F.inline(steps)).withColumn("p_value", binomial_tail(F.col("n"), F.col("rejected"), risk))
    failed = F.min(F.when(F.col("p_value") > delta / len(strata), F.col("step"))).over(Window.partitionBy("stratum"))
    proved = tested.withColumn("failed", failed).where(F.col("failed").isNull() | (F.col("step") < F.col("failed")))
    best = proved.groupBy("stratum").agg(F.max_by(F.struct("step", "n", "rejected", "p_value", "cutoffs"), "step").alias("b"))
    return best.select("stratum", "b.*")


def _fails_any(setting: Column) -> Column:
    out = F.lit(False)
    for rule in RULES:
        out = out | _fails(rule, setting[rule])
    return out


def _fails(rule: str, cutoff: Column) -> Column:
    over, under, _ = RULES[rule]
    return F.coalesce((F.col(under) > 0) & (F.col(over) > cutoff * F.col(under)), F.lit(False))


def quality_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    strata: tuple[str, ...] = ("en", "de", "fr", "es"),
    risk: float = 0.03,
    delta: float = 0.05,
) -> DataFrame:
    """``docs`` less the text, with the statistics, ``base_failed``, ``failed_rules`` and ``kept``.

    ``risk`` bounds the share of a stratum's good documents that the rules reject together, all rules in
    one, with probability 1 - ``delta`` for all strata at once. A stratum whose labels prove nothing has no
    cutoffs: its documents are kept.

    Labels (id, quality) mark good documents with 1. The holdout is every labelled document that
    passes the base rules; a document labelled twice counts as good only if all its labels say so.
    Languages outside ``strata``, null among them, form one further stratum, so the table of cutoffs
    has ``len(strata) + 1`` strata at most and may be broadcast. Texts that are null, empty or
    without words fail the base rules. Equal rows get equal verdicts; an empty table gives no rows.
    """
    docs = docs.drop("base_failed", "failed_rules", "kept")
    group, own, cut = free_name(docs, "stratum", "own", "cutoffs")
    name = F.when(F.col(stratum_col).isin(*strata), F.col(stratum_col)).otherwise(F.lit("other"))
    stats = text_statistics(docs, text_col=text_col).drop(text_col).withColumn(group, name).withColumn("base_failed", base_failed())
    stats = written(stats, "quality-statistics")

    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("own_quality"))
    proposes = F.md5(F.col(id_col).cast("string")) < F.lit(PROPOSING)
    holdout = stats.where(~F.col("base_failed")).join(known.where("own_quality = 1").select(id_col), id_col, "left_semi")
    holdout = holdout.select(F.col(group).alias("holdout_stratum"), proposes.alias("proposes"), *STATISTICS)
    names = [*strata, "other"]
    cutoffs = select_cutoffs(holdout, "holdout_stratum", proposes=F.col("proposes"), strata=names, risk=risk, delta=delta)
    table = small_table(docs.sparkSession, [{"o": s} for s in names], "o:string").select(F.col("o").alias(own))
    table = table.join(cutoffs.select("stratum", F.col("cutoffs").alias(cut)), F.col(own) == F.col("stratum"), "left").drop("stratum")
    judged = stats.join(F.broadcast(table), F.col(group) == F.col(own), "left")
    failed = F.array_compact(F.array(*[F.when(_fails(r, F.col(cut)[r]), F.lit(r)) for r in RULES]))
    judged = judged.withColumn("failed_rules", failed)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return judged.withColumn("kept", kept).drop(group, own, cut)
