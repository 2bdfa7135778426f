"""Secret scans by patterns and a random forest, with DataFrame expressions only.

A pattern finds candidates: private key blocks, web tokens, values assigned to names such as password,
tokens with a known prefix, and long runs of token characters with a digit, after "=" or "." too. For each candidate, expressions measure its length,
character transitions, coverage by dictionary words, path and neighbouring words. A random forest, trained
on labelled findings and written as a sum of CASE expressions, drops false positives.

The labelled findings are made by rule (`labelled`): their kinds, and so their labels, are known. Their
measures come from the same expressions; the forest is grown on the driver from these few hundred rows.
"""

from __future__ import annotations

import random
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "[SECRET]"
_NAMES = r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?)"
_ASSIGN = _NAMES + r"[\"']?\s{0,3}[:=]{1,2}>?\s{0,3}[\"']?"
_PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?!-----)[A-Za-z0-9+/=\s:,-])*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
_JWT = r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"
_PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|sk[-_]|rk_live|AIza|ya29|npm_|SG\.)"
# One alternative for each prefix of KNOWN; eyJ and -----BEGIN are _JWT and _PEM.
_PREFIXED = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9_]{16,}|github_pat_[A-Za-z0-9_]{16,}|glpat-[A-Za-z0-9_-]{16,}|xox[abeprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{16,}|rk_live[A-Za-z0-9_]{16,}|AIza[A-Za-z0-9_-]{16,}|ya29[A-Za-z0-9._-]{16,}|npm_[A-Za-z0-9]{16,}|SG\.[A-Za-z0-9._-]{16,})"
# A run ends before a known prefix, so that a path doesn't swallow the token at its end.
_ON = rf"(?![+/_-]{_PREFIX})"
_RUN = rf"(?<![A-Za-z0-9+/_-])(?=(?:{_ON}[A-Za-z+/_-])*+[0-9])(?:{_ON}[A-Za-z0-9+/_-]){{16,}}+={{0,2}}"
CANDIDATE = f"{_PEM}|{_JWT}|{_ASSIGN}[^\\s\"',;]{{8,}}|{_PREFIXED}|{_RUN}"
KNOWN = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|sk[-_]|rk_live|AIza|ya29|eyJ|-----BEGIN|npm_|SG\.)"
# Words that real identifiers, paths and placeholders are made of.
WORDS = "about access account admin after api app asset auth backup base before build cache class client cloud code commit common config content core data date default demo dev document domain dummy email error event example file first folder form format from function group guide hash head home host html image index info install item java json last layout library line link list local login main manager master media menu message model module name network node note number object order output page part password path plugin post process product profile project public query release report request response result root sample schema script search server service session setting site source stage static status style system table target team template test text theme thread time title token type update upload url user util value version video view web widget word world your".split()
FEATURES = ["length", "transitions", "digits", "uppers", "hexes", "distinct", "covered", "slashes", "name", "assigned", "other", "known", "placeholder", "filed", "grouped"]


def measures(secret: Column, before: Column, after: Column) -> Column:
    """A struct of numbers for a candidate and the text on both sides of it."""
    n = F.greatest(F.length(secret), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(secret, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    left = lambda pattern: F.length(F.regexp_replace(secret, pattern, "")) / n
    flag = lambda text, pattern: text.rlike(pattern).cast("double")
    near = F.right(before, F.lit(48))
    out = {
        "length": F.least(n, F.lit(400.0)),
        "transitions": (F.length(kinds) - 1) / n,
        "digits": 1 - left("[0-9]"),
        "uppers": 1 - left("[A-Z]"),
        "hexes": flag(secret, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "distinct": F.size(F.array_distinct(F.split(secret, ""))) / F.least(n, F.lit(40.0)),
        "covered": 1 - F.length(F.regexp_replace(F.lower(secret), "|".join(sorted(WORDS, key=lambda w: (-len(w), w))), "")) / n,
        "slashes": F.length(F.regexp_replace(secret, "[^/]", "")).cast("double"),
        "name": flag(near, rf"{_NAMES}|(?i:bearer|authorization|login with)"),
        "assigned": flag(near, r"[:=]{1,2}>?\s{0,3}[\"']?$"),
        "other": flag(near, r"(?i)(?:commit|sha-?\d*|md5|hash|checksum|digest|integrity|uuid|guid|etag|revision|version|build|isbn|order|invoice|tracking|phone|card|serial|file|image|path|url|https?:|src|href)\W{0,4}\w{0,12}\W{0,4}$"),
        "known": flag(secret, KNOWN),
        "placeholder": flag(secret, r"(?i)example|x{4,}|\*{3,}|changeme|placeholder|your|dummy|sample|1234567|abcdefg|(.)\1{5,}|^<|\$\{|\{\{"),
        "filed": flag(F.left(after, F.lit(8)), r"^\.[A-Za-z]{1,5}\b|^/"),
        "grouped": flag(secret, r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-|^[A-Za-z0-9]{1,12}(?:[-_][A-Za-z0-9]{1,12})+$|^[A-Z]{0,3}\d{1,}$"),
    }
    return F.struct(*(out[f].cast("double").alias(f) for f in FEATURES))


def labelled(seed: int = 7, each: int = 24) -> list[tuple[str, str, str, int]]:
    """(candidate, text before, text after, whether it is a secret), made by rule."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexes, both = "0123456789abcdef", string.ascii_letters + string.digits
    prose = ["and then the ", "see also ", "in this ", "we have ", "here is the ", "of that "]
    names = ["token = \"", "password: ", "secret='", "api_key=", "apiKey: \"", "SECRET_KEY = \"", "auth_key := ", "access_key=", "pwd=", "credentials: \""]
    others = ["commit ", "sha256: ", "md5 = ", "checksum ", "uuid: ", "etag \"", "revision ", "integrity=\"", "order no. ", "invoice: ", "image: ", "version ", "card ", "phone "]
    settings = ["AWS_ACCESS_KEY_ID=", "GITHUB_PAT=", "STRIPE_KEY=", "export CI_KEY=", "https://site.org/maps?key=", "env.", "KEY: ", "https://site.org/hook/"]
    words = lambda n, sep: sep.join(r.choice(WORDS) for _ in range(n))
    out = []
    for _ in range(each):
        text, name, other = r.choice(prose), r.choice(names), r.choice(others)
        out += [
            (pick(hexes, r.choice((32, 40, 48, 64))), text + name, "\" the", 1),
            (pick(hexes, 40), text + "token = \"", "\" and", 1),
            (pick(both, r.randint(20, 44)) + "1", text + name, r.choice(("\"", "'", "\n")), 1),
            (pick(both, r.randint(9, 15)) + "7!", text + name, "\n", 1),
            ("AKIA" + pick(string.ascii_uppercase + string.digits, 16), text, " is", 1),
            (r.choice(("ghp_", "sk_live_", "xoxb-", "glpat-", "AIza")) + pick(both, 36), text, " ", 1),
            (r.choice(("AKIA", "ASIA")) + pick(string.ascii_uppercase + string.digits, 16), text + r.choice(settings), r.choice(("\n", " ", "&")), 1),
            (r.choice(("ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "sk_live_", "sk-", "rk_live_", "AIza", "ya29.", "npm_", "SG.")) + pick(both, 32), text + r.choice(settings), r.choice(("\n", " ", "&")), 1),
            ("eyJ" + pick(both, 30) + "." + pick(both, 40) + "." + pick(both, 30), r.choice((text, "Bearer ")), " ", 1),
            ("-----BEGIN RSA PRIVATE KEY-----\n" + pick(both + "+/", 300) + "\n-----END RSA PRIVATE KEY-----", text, "\n", 1),
            (pick(both + "+/", 40), text + name, "\"", 1),
            (pick(hexes, r.choice((32, 40, 64))), text + other, " and", 0),
            (pick(hexes, r.choice((32, 40))), text, r.choice((".png", " of", "/raw")), 0),
            ("-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)), text + other, " ", 0),
            (pick(string.digits, r.randint(16, 20)), text + other, " was", 0),
            (pick(string.digits, r.randint(16, 20)), text, " the", 0),
            (words(4, "_") + str(r.randint(1, 99)), text, " is", 0),
            (words(4, "/") + "/" + str(r.randint(1, 2000)), text + r.choice(("path ", "", "https://site.org/")), r.choice((".html", ".js", " ")), 0),
            (words(3, "-") + f"-{r.randint(1990, 2030)}-{r.randint(10, 12)}", text + "/", r.choice(("/", ".html", " ")), 0),
            (r.choice(("your-token-here-123", "changeme1234567", "xxxxxxxxxxxxxxxx1234", "example-key-12345678", "<your-api-key-1>", "aaaaaaaaaaaaaaaa1111")), text + name, "\"", 0),
            (words(3, "/") + "/" + str(r.randint(1, 99999)), text + "https://www.site.", r.choice((".html", " ", "?")), 0),
            (words(2, "-") + "-" + pick(string.digits, 6), text + r.choice(("https://site.org/?page=", "?id=", "class=", "file=")), r.choice(("&", " ", "\"")), 0),
            ("sk" + r.choice("-_") + words(4, "-"), text, " ", 0),
            (words(1, "") + "_" + words(1, "") + "1", text + name, "\n", 0),
            (pick("abdehinorst", r.randint(15, 24)) + pick(string.digits, 1), text, r.choice((" ", ". ")), 0),
            (pick("abdehinorst", r.randint(6, 14)) + "-" + pick("abdehinorst", 6) + pick(string.digits, 2), text, " in", 0),
        ]
    return out


def grow(x: list[list[float]], y: list[int], trees: int = 25, depth: int = 5, seed: int = 11) -> list:
    """A forest: trees are nested (feature, limit, at most, above) tuples with shares of secrets as leaves.
    Each tree sees a bootstrap of the rows, each split four features at random, by Gini impurity."""
    r = random.Random(seed)

    def split(rows: list[int], level: int):
        share = (sum(y[i] for i in rows) + 0.5) / (len(rows) + 1)
        if level == 0 or share < 0.05 or share > 0.95 or len(rows) < 4:
            return share
        best = None
        for f in r.sample(range(len(FEATURES)), 4):
            values = sorted({x[i][f] for i in rows})
            for a, b in list(zip(values, values[1:], strict=False))[:: max(1, len(values) // 16)]:
                cut = (a + b) / 2
                low = [y[i] for i in rows if x[i][f] <= cut]
                n, m, p = len(rows), len(low), sum(low)
                q = n - m
                s = sum(y[i] for i in rows) - p
                score = 2 * p * (m - p) / m + 2 * s * (q - s) / q
                if best is None or score < best[0]:
                    best = score, f, cut
        if best is None:
            return share
        _, f, cut = best
        return f, cut, split([i for i in rows if x[i][f] <= cut], level - 1), split([i for i in rows if x[i][f] > cut], level - 1)

    return [split([r.randrange(len(x)) for _ in x], depth) for _ in range(trees)]


def chance(forest: list, m: Column) -> Column:
    """The forest's mean share of secrets, as one expression over a struct of measures."""

    def tree(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        f, cut, low, high = t
        return F.when(m[FEATURES[f]] <= F.lit(float(cut)), tree(low)).otherwise(tree(high))

    return reduce(lambda a, b: a + b, map(tree, forest)) / len(forest)


_forests: dict[str, list] = {}


def forest(spark: SparkSession) -> list:
    """Grown once in a session from the labelled findings, measured by Spark."""
    key = spark.sparkContext.applicationId
    if key not in _forests:
        rows = labelled()
        made = F.inline(F.array(*(F.struct(*(F.lit(v) for v in r)) for r in rows))).alias("s", "b", "a", "y")
        found = spark.range(1).select(made).select(measures(F.col("s"), F.col("b"), F.col("a")).alias("m"), "y").collect()
        _forests[key] = grow([[r.m[f] for f in FEATURES] for r in found], [r.y for r in found])
    return _forests[key]


def scan(rows: DataFrame, text: Column, keep: float = 0.5) -> DataFrame:
    """rows (row) with parts (the text between candidates) and found: array<struct<head, secret, start, score,
    kept>>, where head is what a match has before its secret, such as a name and an equals sign. Both are
    empty for texts without candidates and null texts."""
    trees, none = forest(rows.sparkSession), F.array().cast("array<string>")
    d = rows.withColumn("has", F.coalesce(text.rlike(CANDIDATE), F.lit(False)))
    d = d.withColumn("parts", F.when(F.col("has"), F.split(text, CANDIDATE, -1)).otherwise(none))
    d = d.withColumn("match", F.when(F.col("has"), F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))).otherwise(none))
    head = lambda s: F.regexp_extract(s, f"^(?:{_ASSIGN})?", 0)
    found = F.transform("match", lambda s, i: F.struct(i.alias("i"), head(s).alias("head"), s.alias("match")))
    found = F.transform(found, lambda x: F.struct(x["head"].alias("head"), F.substring(x["match"], F.length(x["head"]) + 1, F.length(x["match"])).alias("secret"), F.concat(F.get("parts", x["i"]), x["head"]).alias("before"), F.get("parts", x["i"] + 1).alias("after")))
    d = d.withColumn("found", found)
    d = d.withColumn("found", F.transform("found", lambda x: x.withField("m", measures(x["secret"], x["before"], x["after"]))))
    d = d.withColumn("found", F.transform("found", lambda x: F.struct(x["head"].alias("head"), x["secret"].alias("secret"), F.length(x["before"]).cast("long").alias("before"), chance(trees, x["m"]).alias("score"))))
    out = F.aggregate(
        "found",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<head string, secret string, start long, score double, kept boolean>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["before"] + F.length(x["secret"])).alias("at"),
            F.concat(s["out"], F.array(F.struct(x["head"].alias("head"), x["secret"].alias("secret"), (s["at"] + x["before"]).alias("start"), x["score"].alias("score"), (x["score"] >= keep).alias("kept")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return d.withColumn("found", out).drop("match", "has")


def as_rows(docs: DataFrame) -> DataFrame:
    """docs as one struct column `row`, beside which other columns may have any name."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def findings(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """(doc_id, start, length, secret_sha256, score, kept): one row for each candidate; kept ones are secrets.

    start counts characters from 0. Null and empty texts and texts without candidates give no rows;
    repeated rows give theirs each; an empty table gives none; texts and candidates are searched and measured
    whole; null ids stay. Extra columns are left out.
    """
    rows = as_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = scan(rows, F.col("row.text"), keep).select("row.doc_id", F.explode("found").alias("f"))
    return found.select("doc_id", "f.start", F.length("f.secret").cast("long").alias("length"), F.sha2(F.col("f.secret"), 256).alias("secret_sha256"), "f.score", "f.kept")


def redact(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """docs with each secret in `text` replaced by a mark; other rows as they were, n_chars (if any) follows.

    Null and empty texts and texts without secrets stay as they are, repeated rows are treated alike, long
    texts are searched whole, an empty table gives no rows. All columns stay, whatever their names.
    """
    d = scan(as_rows(docs), F.col("row.text"), keep)
    pieces = F.transform("found", lambda x, i: F.concat(F.get("parts", i), x["head"], F.when(x["kept"], F.lit(MARK)).otherwise(x["secret"])))
    d = d.withColumn("hit", F.exists("found", lambda x: x["kept"]))
    d = d.withColumn("new", F.when(F.col("hit"), F.concat(F.array_join(pieces, ""), F.element_at("parts", -1))).otherwise(F.col("row.text")))
    kind = dict(docs.dtypes)
    new = {"text": F.col("new")} | ({"n_chars": F.when(F.col("hit"), F.length("new").cast(kind["n_chars"])).otherwise(F.col("row.n_chars"))} if "n_chars" in kind else {})
    return d.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))
