"""Secret scans: patterns find candidates, a random forest removes false positives.

Candidates are values given to a telling name, key blocks, and unbroken runs of at least 16 key characters with
a digit, each in its whole length. Features of a candidate are its length, its character classes and their transitions, its entropy,
how much of it dictionary words cover, what its path says, and the words before and after it. The forest (Spark's
own) is trained from labelled findings: the caller's, or generated ones of bounded number. Everything is
DataFrame and SQL functions; texts don't move.

A text is cut at its matches once, so a candidate's place, and the text around it, come from the pieces and no text is
searched again; work is linear in a text's length. Every place of a value is scored; a finding takes its best score.

Defined results: null and empty texts have no findings; a value found several times in a text is one finding
with its first place, its number of places and its highest score; a null path tells nothing; repeated rows, and rows
with a null or repeated id, each have their own findings; equal scores need no order; other columns are never looked at,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import let
from .common import col, packed, read

#: Generated labelled findings, and the most that are taken from a caller's.
GENERATED, MOST_LABELLED = 8_000, 200_000
TREES, DEPTH, SEED = 40, 8, 42
NEAR = 48
SECRET_AT = 0.5

# Names that announce a secret, known key forms, words that fill placeholders, words near harmless values.
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?"
# a key block up to its END line; of one without it, the lines of its body. Possessive throughout: no length is too much
BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----|(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{32,}+)*+)"
CANDIDATE = (
    rf"(?i:(?:{NAMES})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?(?=[^\s\"'<>]{{8}})(?:(?-i:{BLOCK})|[^\s\"'<>]{{8,}}+))"
    rf"|{BLOCK}"
    r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+"
)
NAMED = rf"(?is)^(?:{NAMES})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?(.*)$"
KNOWN = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^xox[abprs]-|^sk_(?:live|test)_|^AIza[A-Za-z0-9_-]{35}|^eyJ[A-Za-z0-9_-]+|^glpat-|^-----BEGIN"
DICTIONARY = "example sample dummy changeme change placeholder insert replace your here secret password token value user name test demo none null true false http https www com org net the and for with from that this version index image data file path page item list node type key default config public static class function return string number".split()
HARMLESS = r"(?i)\b(?:sha|sha1|sha256|md5|commit|checksum|digest|hash|uuid|guid|revision|version|build|invoice|order|card|phone|tel|isbn|serial|example|sample|dummy|placeholder|fixture)\b"
TELLING = rf"(?i)\b(?:{NAMES}|key|login|bearer|aws|signature)\b"
TEST_PATH = r"(?i)(?:^|[/_.-])(?:tests?|examples?|samples?|docs?|fixtures?|mocks?|vendor|node_modules)(?:[/_.-]|$)"
CONFIG_PATH = r"(?i)\.(?:env|ini|cfg|conf|ya?ml|toml|json|properties|tf|sh)$"

FEATURES = ["f_length", "f_digit", "f_upper", "f_lower", "f_other", "f_runs", "f_letter_runs", "f_vowels", "f_distinct", "f_entropy", "f_dictionary", "f_known", "f_hex", "f_named", "f_quoted", "f_telling", "f_harmless", "f_harmless_after", "f_test_path", "f_config_path"]


def _share(c: Column, pattern: str) -> Column:
    """Share of a text's characters that match a class."""
    return F.length(F.regexp_replace(c, f"[^{pattern}]", "")) / F.greatest(F.length(c), F.lit(1))


def with_features(found: DataFrame) -> DataFrame:
    """found: value, named, before, after, path. Adds the ``FEATURES``."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    runs = lambda c: F.length(F.regexp_replace(c, r"(.)\1+", "$1")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9]", "."), "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "0")
    sounds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(v), "[aeiouy]", "A"), "[b-df-hj-np-tv-xz]", "C"), "[^AC]", ".")
    letters = F.array_distinct(F.split(v, ""))
    entropy = F.aggregate(F.transform(letters, lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n), F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    flag = lambda c, pattern: F.coalesce(c, F.lit("")).rlike(pattern).cast("double")
    words = F.length(F.regexp_replace(F.lower(v), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    return found.withColumns(
        {
            "f_length": F.log2(n.cast("double")),
            "f_digit": _share(v, "0-9"),
            "f_upper": _share(v, "A-Z"),
            "f_lower": _share(v, "a-z"),
            "f_other": 1 - _share(v, "A-Za-z0-9"),
            "f_runs": runs(kinds),
            "f_letter_runs": runs(sounds),
            "f_vowels": _share(F.lower(v), "aeiou"),
            "f_distinct": F.size(letters) / n,
            "f_entropy": entropy,
            "f_dictionary": (n - words) / n,
            "f_known": flag(v, KNOWN),
            "f_hex": flag(v, "^[0-9a-f]{16,}$"),
            "f_named": F.col("named").cast("double"),
            "f_quoted": flag(F.substring("after", 1, 1), "[\"']"),
            "f_telling": flag(F.col("before"), TELLING),
            "f_harmless": flag(F.col("before"), HARMLESS),
            "f_harmless_after": flag(F.col("after"), HARMLESS),
            "f_test_path": flag(F.col("path"), TEST_PATH),
            "f_config_path": flag(F.col("path"), CONFIG_PATH),
        }
    )


def _pieces(text: Column) -> Column:
    """array<struct<gap, match, before, after>>: each match behind the text since the last one, and up to ``NEAR`` characters around it. The last piece is the rest, without a match."""

    def zipped(s: Column) -> Column:
        m, g = s["m"], s["g"]
        n, none = F.size(m), F.array(F.lit(""))
        z = F.arrays_zip(g.alias("gap"), m.alias("match"), F.concat(none, m).alias("last"), F.concat(F.slice(g, F.lit(2), n), none).alias("rest"), F.concat(F.slice(m, F.lit(2), n), none).alias("next"))
        return F.transform(z, lambda x: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), F.right(F.concat(x["last"], x["gap"]), F.lit(NEAR)).alias("before"), F.left(F.concat(x["rest"], F.coalesce(x["next"], F.lit(""))), F.lit(NEAR)).alias("after")))

    return let(F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("m"), F.split(text, CANDIDATE).alias("g")), zipped)


def _value(match: Column) -> Column:
    """struct<head, value, tail>: what a match assigns, without closing punctuation, or the whole match (then head is empty)."""
    given = lambda v: F.when(v != "", F.regexp_replace(v, r"[.,;:!?)\]}]+$", "")).otherwise(match)
    parts = lambda v: F.struct(F.left(match, F.length(match) - F.length(F.when(v != "", v).otherwise(match))).alias("head"), given(v).alias("value"), F.when(v != "", F.right(v, F.length(v) - F.length(given(v)))).otherwise("").alias("tail"))
    return let(F.regexp_extract(match, NAMED, 1), parts)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(rid, id, text_key, at, value, named, before, after, path): a row per place of a candidate; ``rid`` tells rows apart."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    path = col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = df.select(F.monotonically_increasing_id().alias("rid"), col(id_col).alias("id"), _text_key(text_col), path.alias("path"), text.alias("text"))
    small = lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))
    # outer: else Spark infers a filter that runs the pattern once more
    met = rows.select("rid", "id", "text_key", "path", F.posexplode_outer(F.transform(_pieces(F.col("text")), small)).alias("i", "p")).where("p.match is not null")
    ends = F.sum(F.col("p.gap") + F.length("p.match")).over(W.partitionBy("rid").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    met = met.withColumn("v", _value(F.col("p.match"))).withColumn("ends", ends).where(F.length("v.value") >= 8)
    at = F.col("ends") - F.length("p.match") + F.length("v.head")
    return met.select(
        "rid", "id", "text_key", at.cast("long").alias("at"), "v.value", (F.length("v.head") > 0).alias("named"), F.right(F.concat("p.before", "v.head"), F.lit(NEAR)).alias("before"), F.left(F.concat("v.tail", "p.after"), F.lit(NEAR)).alias("after"), "path"
    )


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")), F.length(col(text_col))).alias("text_key")


def generated_findings(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """Labelled findings from rules: keys and random values in telling places against digests, ids, placeholders, numbers and words."""
    i = F.col("id")
    pick = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    hexes = lambda salt, m: F.substring(F.sha2(F.concat(F.lit(salt), i.cast("string")).cast("binary"), 512), 1, m)
    b64 = lambda salt, m: F.substring(F.regexp_replace(F.base64(F.unhex(hexes(salt, 128))), "[+/=]", "x"), 1, m)
    long = F.concat(*[b64(f"l{k}", 86) for k in range(13)])
    lines = F.array_join(F.array(*[b64(f"b{k}", 64) for k in range(12)]), "\n")
    signed = F.concat(F.lit("eyJ"), F.substring(b64("e", 60), 1, 20), F.lit("."))
    upper = lambda salt, m: F.substring(F.regexp_replace(F.upper(F.base64(F.unhex(hexes(salt, 128)))), "[+/=0189]", "K"), 1, m)
    word = lambda salt: pick(salt, "the", "reading", "where", "value", "river", "open", "of", "and", "table", "nation", "ering", "schaft", "mente", "eaux")
    plain = F.concat_ws(" ", word("a"), word("b"), word("c"), F.lit(""))
    name = pick("n", "password", "token", "secret", "api_key", "auth", "PASSWORD", "access_key")
    tie = pick("t", "=", ": ", " = \"", "='", ":")
    given = F.concat(plain, name, tie)
    harmless = F.concat(plain, pick("h", "sha256", "commit", "md5", "checksum", "revision", "uuid", "digest", "order", "card", "example"), F.lit(" "))
    digits = F.regexp_replace(hexes("d", 64), "[a-f]", "7")
    uuid = F.regexp_replace(hexes("u", 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    # label, value, named, before
    kinds = [
        (1, F.concat(F.lit("AKIA"), upper("k", 16)), False, plain),
        (1, hexes("p", 40), True, given),
        (1, hexes("q", 18), True, given),
        (1, b64("r", 24), True, given),
        (1, F.concat(F.lit("ghp_"), b64("g", 36)), False, plain),
        (1, F.concat(F.lit("sk_live_"), b64("s", 24)), False, given),
        (1, F.concat(F.lit("eyJ"), b64("j", 60)), False, F.concat(plain, F.lit("bearer "))),
        (1, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), lines, F.lit("\n-----END RSA PRIVATE KEY-----")), False, plain),
        (1, F.substring(long, 1, 342), False, F.concat(plain, F.lit("bearer "), signed)),
        (1, F.substring(long, 1, 300 + F.pmod(i, F.lit(9)) * 100), True, given),
        (0, hexes("c", 40), False, harmless),
        (0, hexes("m", 32), False, harmless),
        (0, hexes("y", 64), False, plain),
        (0, uuid, False, plain),
        (0, F.substring(digits, 1, 16), False, plain),
        (0, F.substring(digits, 3, 20), False, harmless),
        (0, F.concat(pick("x", "your_api_key_here", "example_token_value", "changeme_password", "placeholder_secret", "dummy-test-key-value"), F.substring(digits, 1, 2)), True, given),
        (0, F.concat(word("e"), F.lit("_"), word("f"), F.lit("_"), word("g"), F.lit("_"), F.substring(digits, 1, 3)), False, plain),
        (0, F.concat(word("e"), word("f"), word("g"), word("o")), True, given),
        (0, F.concat(F.lit("static/images/"), word("e"), F.lit("/"), word("f"), F.lit("-"), F.substring(digits, 1, 4)), False, plain),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    case = lambda f: reduce(lambda c, k: c.when(kind == k[0], f(k[1])), enumerate(kinds), F.when(F.lit(False), None))
    path = pick("w", "src0", "app/settings.env", "tests/data/sample.json", "docs/readme.md", "lib/client.py", None)
    return spark.range(0, n, 1, 1).select(
        case(lambda k: k[1]).alias("value"), case(lambda k: F.lit(k[2])).alias("named"), case(lambda k: k[3]).alias("before"), pick("z", "\" ", " ", "\n", "' and", ", then the ", ";").alias("after"), path.alias("path"), case(lambda k: F.lit(float(k[0]))).alias("label")
    )


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """The forest from labelled findings (value, named, before, after, path, label 0 or 1): all, or those ``MOST_LABELLED`` whose hash is lowest."""
    taken = labelled.orderBy(F.xxhash64(*map(col, labelled.columns))).limit(MOST_LABELLED)
    rows = with_features(taken).select("label", *FEATURES)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features").fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def scan(df: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row per value found in a row: id, at (code points before its first place), value, named, occurrences, score and is_secret, and the key of its text."""
    found = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(df, id_col, text_col, path_col)))
    scored = model.transform(found).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    by_value = scored.groupBy("rid", "value").agg(F.first("id").alias("id"), F.first("text_key").alias("text_key"), F.min("at").alias("at"), F.max("named").alias("named"), F.count("*").alias("occurrences"), F.max("score").alias("score"))
    return by_value.select(F.col("id").alias(id_col), "at", "value", "named", "occurrences", "score", (F.col("score") >= SECRET_AT).alias("is_secret"), "text_key")


def redact(df: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``df`` with the secrets of ``scan``'s findings replaced where they were found; rows are met by id and text."""
    values = findings.where("is_secret").groupBy(col(id_col).alias("id"), "text_key").agg(F.collect_set("value").alias("values"))
    rows = df.select(packed(df), col(id_col).alias("id"), _text_key(text_col), col(text_col).cast("string").alias("text")).alias("r")
    met = rows.join(values.alias("v"), (F.col("r.text_key") == F.col("v.text_key")) & F.col("r.id").eqNullSafe(F.col("v.id")), "left").select("r.row", "r.text", "v.values")
    hidden = lambda v, match: F.when(F.array_contains("values", v["value"]), F.concat(v["head"], F.lit(mask), v["tail"])).otherwise(match)
    piece = lambda x: F.concat(x["gap"], F.when(x["match"].isNull(), "").otherwise(let(_value(x["match"]), lambda v: hidden(v, x["match"]))))
    clean = met.select("row", F.when(F.col("values").isNull(), F.col("text")).otherwise(F.array_join(F.transform(_pieces(F.col("text")), piece), "")).alias("clean"))
    return clean.select(*[F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), train(generated_findings(spark)))
