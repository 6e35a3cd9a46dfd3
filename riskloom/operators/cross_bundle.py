"""Signals shared between bundles. Every group is pre-aggregated before it moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import sqltext as S
from riskloom.functions import text as T
from riskloom.functions.urls import hosts
from riskloom.session import Steps

# Collector, sender and shared-pattern tests; word lists; everyday domains.
COLLECTOR = (
    r"(?i)\b(?:credential\w*|password\w*|secret\w*|api_key\w*|token\w*|auth[_-]?(?:token|key|secret))\b",
    r"(?i)\b\.env\b",
    r"(?i)\bconfig\b.*\b(?:key|secret|password)\b",
    r"(?i)\bssh\b.*\b(?:key|pem|id_rsa)\b",
    r"(?i)\bkeychain\b|\bwallet\b|\bcookie\b",
)
SENDER = (
    r"(?i)requests\.post|urllib\.request|socket\.send",
    r"(?i)\bwebhook\b|\bngrok\b|\btunnel\b",
    r"(?i)curl.*-X\s*POST|curl.*--data",
)
SHARED_PATTERNS = {
    "base64_decode": r"base64[\s.]*(?:b64)?decode",
    "exec_call": r"\bexec\s*\(",
    "eval_call": r"\beval\s*\(",
    "hex_escape": r"\\x[0-9a-fA-F]{2}",
    "chr_call": r"\bchr\s*\(\s*\d+\s*\)",
    "getattr_dynamic": r"""getattr\s*\([^,]+,\s*["']""",
}
COLLECTOR_WORDS = "gather collect read scan fetch extract retrieve download import load parse".split()
SENDER_WORDS = "send upload post transfer sync export share transmit deliver push submit".split()
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall to of "
    "in for on with at by from as into through during before after above below between out off over under again further "
    "then once that this these those and but or nor not so yet both each every all any few more most other some such no "
    "only own same than too very just because if when where how what which who whom while although though until unless "
    "since about tool utility helper assistant service agent skill plugin extension function feature"
).split()
COMMON_DOMAINS = (
    "github.com gitlab.com bitbucket.org pypi.org npmjs.com npmjs.org npm.io crates.io rubygems.org packagist.org "
    "hub.docker.com docker.io cloud.google.com aws.amazon.com azure.com stackoverflow.com stackexchange.com "
    "wikipedia.org wikimedia.org google.com googleapis.com gstatic.com microsoft.com apple.com mozilla.org "
    "rust-lang.org python.org nodejs.org deno.land bun.sh astral.sh anthropic.com openai.com"
).split()


def bundle_texts(files: DataFrame, bundles: DataFrame) -> DataFrame:
    """Every text of a bundle: its readable files and its description, one row each."""
    texts = files.where(~F.col("is_binary")).select("bundle_id", F.col("content").alias("text"))
    described = bundles.where(F.col("description") != "").select("bundle_id", F.col("description").alias("text"))
    return texts.unionByName(described)


def text_facts(texts: DataFrame) -> DataFrame:
    """What each text shows and which hosts it names, without the text."""
    patterns = {"collects": COLLECTOR, "sends": SENDER, **{name: (p,) for name, p in SHARED_PATTERNS.items()}}
    flags = {name: F.expr(S.guarded("text", "folded", ps)) for name, ps in patterns.items()}
    folded = texts.withColumn("folded", T.folded(F.col("text")))
    return folded.select("bundle_id", *[test.alias(name) for name, test in flags.items()], hosts(F.col("text")).alias("hosts"))


def signals_of(facts: DataFrame) -> DataFrame:
    names = [c for c in facts.columns if c not in ("bundle_id", "hosts")]
    return facts.groupBy("bundle_id").agg(*[F.max(name).alias(name) for name in names])


def bundle_signals(texts: DataFrame) -> DataFrame:
    """Per bundle: does any of its texts collect, send, or show a shared pattern."""
    return signals_of(text_facts(texts))


def data_relay(signals: DataFrame) -> DataFrame:
    """One row when some bundle collects and a different one sends."""
    def n(test: Column) -> Column:
        return F.count(F.when(test, 1))

    counts = signals.agg(
        n(F.col("collects")).alias("n_collectors"), n(F.col("sends")).alias("n_senders"),
        n(F.col("collects") & F.col("sends")).alias("n_both"),
    )
    distinct_pair = (F.col("n_collectors") > 0) & (F.col("n_senders") > 0) & ~(
        (F.col("n_collectors") == 1) & (F.col("n_senders") == 1) & (F.col("n_both") == 1)
    )
    return counts.where(distinct_pair).select(
        F.lit("CROSS_SKILL_DATA_RELAY").alias("rule_id"), F.lit("Network").alias("category"),
        F.lit("High").alias("severity"), "n_collectors", "n_senders",
    )


def shared_domains(texts: DataFrame) -> DataFrame:
    """Hosts named by two bundles or more, everyday hosts left out."""
    return domains_of(texts.select("bundle_id", hosts(F.col("text")).alias("hosts")))


def domains_of(facts: DataFrame) -> DataFrame:
    rows = facts.select("bundle_id", F.explode("hosts").alias("domain"))
    pairs = rows.where(~F.col("domain").isin(*COMMON_DOMAINS)).distinct()
    return pairs.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_bundles"), F.min("bundle_id").alias("first_bundle"), F.max("bundle_id").alias("last_bundle")
    ).where(F.col("n_bundles") >= 2)


def shared_domain_members(texts: DataFrame) -> DataFrame:
    """The bundles that name a shared host, a row each."""
    rows = texts.select("bundle_id", F.explode(hosts(F.col("text"))).alias("domain"))
    pairs = rows.where(~F.col("domain").isin(*COMMON_DOMAINS)).distinct()
    shared = pairs.groupBy("domain").count().where("count >= 2").select("domain")
    return pairs.join(shared, "domain", "left_semi").select("domain", "bundle_id")


def shared_pattern_members(signals: DataFrame) -> DataFrame:
    """The bundles that show a shared pattern, a row each."""
    rows = F.array(*[F.when(F.col(n), F.lit(n)) for n in SHARED_PATTERNS])
    members = signals.select("bundle_id", F.explode(F.filter(rows, lambda p: p.isNotNull())).alias("pattern"))
    return members.join(shared_patterns(signals).select("pattern"), "pattern", "left_semi").select("pattern", "bundle_id")


def shared_patterns(signals: DataFrame) -> DataFrame:
    """Suspicious patterns seen in two bundles or more: six counters, then six rows."""
    counts = signals.agg(*[F.count(F.when(F.col(n), 1)).alias(n) for n in SHARED_PATTERNS])
    rows = F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).alias("n_bundles")) for n in SHARED_PATTERNS])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where(F.col("n_bundles") >= 2)


def described(bundles: DataFrame) -> DataFrame:
    """bundle_id, context words, roles and class of every description; a class is all that have these words and roles."""
    lower = F.lower("description")
    words = F.filter(F.split(lower, r"(?U)[^\p{Alnum}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    rows = bundles.where(F.col("description") != "").select(
        F.sort_array(words).alias("words"),
        lower.rlike("|".join(COLLECTOR_WORDS)).alias("collects"), lower.rlike("|".join(SENDER_WORDS)).alias("sends"),
        "bundle_id",
    )
    roles = F.concat_ws("|", F.array_join("words", " "), F.col("collects").cast("string"), F.col("sends").cast("string"))
    return rows.withColumn("class_id", F.md5(roles))


def description_roles(bundles: DataFrame) -> DataFrame:
    """Distinct descriptions' context words and roles, with the number of bundles that share them."""
    return described(bundles).groupBy("words", "collects", "sends", "class_id").agg(
        F.count(F.lit(1)).alias("n_bundles"), F.min("bundle_id").alias("first_bundle"), F.max("bundle_id").alias("last_bundle")
    ).withColumn("context", F.array_join("words", " "))


def word_keys(bundles: DataFrame) -> DataFrame:
    """word_a, word_b, roles and class of each pair of context words of a class that collects or sends.

    A word that a collector repeats counts each time, so it also meets a sender's single word, under the key (word, word).
    """
    words, distinct = F.col("words"), F.col("distinct")
    crossed = F.flatten(F.transform(
        distinct,
        lambda a: F.transform(
            F.filter(distinct, lambda b: b > a),
            lambda b: F.struct(a.alias("word_a"), b.alias("word_b"), F.col("collects").alias("collects"), F.col("sends").alias("sends")),
        ),
    ))
    same = F.transform(distinct, lambda w: F.struct(
        w.alias("word_a"), w.alias("word_b"),
        (F.col("collects") & (F.size(F.filter(words, lambda v: v == w)) > 1)).alias("collects"), F.col("sends").alias("sends"),
    ))
    roles = description_roles(bundles).where("collects OR sends").withColumn("distinct", F.array_distinct("words"))
    own = ("class_id", "n_bundles", "first_bundle", "last_bundle")
    return roles.select(*own, F.explode(F.concat(crossed, same)).alias("k")).select(*own, "k.*")


def complementary_descriptions(bundles: DataFrame) -> DataFrame:
    """Pairs of context words that some bundle's collecting and another's sending description share.

    One row for each pair of words, with how many descriptions of either role hold both and how many pairs of bundles
    that makes; pairs of descriptions are not listed, as they grow with the square of the bundles: which ones pair up
    follows from complementary_index and complementary_members. Counts combine on the map side, so a pair of words may be
    as common as it likes.
    """
    def n(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n_bundles")).otherwise(0))

    counts = word_keys(bundles).groupBy("word_a", "word_b").agg(
        n(F.col("collects")).alias("n_collectors"), n(F.col("sends")).alias("n_senders"), n(F.col("collects") & F.col("sends")).alias("n_both")
    )
    # A bundle does not pair with itself.
    pairs = F.col("n_collectors") * F.col("n_senders") - F.col("n_both")
    return counts.where(pairs > 0).select("word_a", "word_b", "n_collectors", "n_senders", pairs.alias("n_pairs"))


def complementary_index(bundles: DataFrame) -> DataFrame:
    """For each pair of words that complementary_descriptions lists, the classes that hold it, and as what.

    Two different bundles pair up exactly if some pair of words has a row of the one's class that collects and a row of
    the other's that sends. The index grows with the descriptions and their words, not with the pairs.
    """
    keys = word_keys(bundles).where("collects OR sends")
    pairs = complementary_descriptions(bundles).select("word_a", "word_b")
    # One row a pair of words on the right, so a common pair's rows on the left may be split over tasks.
    return keys.join(pairs, ["word_a", "word_b"], "left_semi").select("word_a", "word_b", "class_id", "collects", "sends")


def complementary_members(bundles: DataFrame) -> DataFrame:
    """class_id and bundle_id of every bundle whose description collects or sends."""
    return described(bundles).where("collects OR sends").select("class_id", "bundle_id")


def complementary_examples(bundles: DataFrame) -> DataFrame:
    """One pair of bundles for each pair of words: collector and sender, two different ones.

    If the first collector is the last sender and the last collector the first sender, all of them are one bundle.
    """
    def edge(role: str, of, which: str) -> Column:
        return of(F.when(F.col(role), F.col(which)))

    found = word_keys(bundles).groupBy("word_a", "word_b").agg(
        edge("collects", F.min, "first_bundle").alias("c_first"), edge("collects", F.max, "last_bundle").alias("c_last"),
        edge("sends", F.min, "first_bundle").alias("s_first"), edge("sends", F.max, "last_bundle").alias("s_last"),
    ).where("c_first is not null and s_first is not null")
    pair = F.when(F.col("c_first") != F.col("s_last"), F.struct(F.col("c_first").alias("collector"), F.col("s_last").alias("sender"))).when(
        F.col("c_last") != F.col("s_first"), F.struct(F.col("c_last").alias("collector"), F.col("s_first").alias("sender"))
    )
    return found.select("word_a", "word_b", pair.alias("p")).where("p is not null").select("word_a", "word_b", "p.collector", "p.sender")


def corpus_findings(files: DataFrame, bundles: DataFrame) -> DataFrame:
    """The four kinds of corpus-wide findings in one shape.

    Texts are read once: what they show is kept as a table without them, and all four kinds follow from it and from the
    descriptions.
    """
    steps = Steps(files.sparkSession, "corpus")
    described = steps.keep(bundles.select("bundle_id", "description"), "descriptions")
    facts = steps.keep(text_facts(bundle_texts(files, described)), "facts")
    signals = steps.keep(signals_of(facts), "signals")

    def shaped(df: DataFrame, rule: str, category: str, severity: str, subject: Column) -> DataFrame:
        return df.select(
            F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
            F.lit("Medium").alias("confidence"), F.lit("cross_bundle").alias("analyzer"), subject.alias("subject"),
        )

    return (
        shaped(data_relay(signals), "CROSS_SKILL_DATA_RELAY", "Network", "High", F.lit("relay"))
        .unionByName(shaped(domains_of(facts), "CROSS_SKILL_SHARED_URL", "Obfuscation", "Medium", F.col("domain")))
        .unionByName(shaped(complementary_descriptions(described), "CROSS_SKILL_COMPLEMENTARY_TRIGGERS", "SocialEngineering",
                            "Low", F.concat_ws(" / ", "word_a", "word_b")))
        .unionByName(shaped(shared_patterns(signals), "CROSS_SKILL_SHARED_PATTERN", "Obfuscation", "Medium", F.col("pattern")))
    )
