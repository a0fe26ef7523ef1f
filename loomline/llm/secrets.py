"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters that mix letters and digits, and values
assigned to a telling name.  Features are SQL expressions over the candidate (length,
character transitions, dictionary coverage, path shape) and its neighbouring words;
the forest (MLlib, JVM-side) is trained here from labelled findings.  Built-in
functions only.
"""

from __future__ import annotations

import random
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Labelled findings made for training: a bounded set.
FINDINGS, SEED, TREES, DEPTH = 3000, 7, 20, 8
AROUND = 3
#: A long run of key characters, the ends of runs, and what parts the fields of a word (of JSON, CSV, query and connection strings).
KEY = "A-Za-z0-9+/_.~-"
RUN = f"[{KEY}]{{7,}}[A-Za-z0-9+/_-]"
ENDS = f"(?<=[{KEY}])(?=[^{KEY}])|(?<=[^{KEY}])(?=[{KEY}])"
FIELDS = "[,;&{}?|()<>]"
#: Runs and marks before a run, in its field, that may hold its name.
NAME_PARTS = 6
KEYWORDS = r"(?i)(secret|token|passw|passwd|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
BENIGN = r"(?i)\b(commit|sha1?|sha256|md5|checksum|digest|hash|uuid|guid|revision|version|etag|isbn|order|invoice|ticket|build|example|sample|file|path|page|id)\b"
#: Frequent English words and letter groups, longest first, as a dictionary of syllables.
DICTIONARY = (
    "ation", "tion", "able", "ible", "ment", "ness", "less", "which", "there", "their", "would", "other", "test", "data", "name", "user", "file", "time", "config",
    "ing", "the", "and", "ent", "ion", "ter", "est", "ers", "ati", "hat", "ate", "all", "eth", "hes", "ver", "his", "oft", "ith", "fth", "sth", "oth", "res", "ont",
    "th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur",
)
_FEATURES = ("length", "letter_digit", "case_turns", "digit_share", "upper_share", "hex_share", "distinct_share", "longest_run", "coverage", "slashes", "dots", "dashes", "extension", "assigned", "keyword", "benign", "known_prefix")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, word, candidate, before, after) of each candidate in ``docs(doc_id, text)``.

    ``word`` is the place of the white-space separated word that holds it (from 0); a
    word has as many candidates as it has runs that qualify, each under the name
    before it in its own field.
    """
    maybe = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike("[0-9]|" + KEYWORDS))
    w = maybe.select("doc_id", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w"))
    assigned = KEYWORDS + r"[\w-]*[\"']?\s*[:=]"
    # Words around are cut out only for the few words that may hold a candidate.
    near = F.filter(
        F.transform(
            "w",
            lambda x, i: F.when(
                (F.length(x) >= 8) & x.rlike(RUN),
                F.struct(
                    i.cast("long").alias("word"), x.alias("whole"),
                    F.array_join(F.slice("w", F.greatest(i - AROUND, F.lit(0)) + 1, F.least(i, F.lit(AROUND))), " ").alias("before"),
                    F.array_join(F.slice("w", i + 2, F.lit(AROUND)), " ").alias("after"),
                ),
            ),
        ),
        lambda s: s.isNotNull() & (((F.length(s["whole"]) >= 16) & s["whole"].rlike("[0-9]")) | F.concat(s["before"], F.lit(" "), s["whole"]).rlike(assigned)),
    )

    def runs(parts: Column) -> Column:
        """(candidate, name) of each long run of a field."""

        def one(x: Column, i: Column) -> Column:
            mark = F.coalesce(F.get(parts, i + 1), F.lit(""))
            # An equals sign is padding if no value follows it.
            padding = F.when(i + 2 >= F.size(parts), F.regexp_extract(mark, "^={1,2}", 0)).otherwise(F.regexp_extract(mark, "^(={1,2})[^=\"']", 1))
            name = F.array_join(F.slice(parts, F.greatest(i - NAME_PARTS, F.lit(0)) + 1, F.least(i, F.lit(NAME_PARTS))), "")
            return F.when(x.rlike(RUN), F.struct(F.concat(F.regexp_extract(x, RUN, 0), padding).alias("candidate"), name.alias("name")))

        return F.filter(F.transform(parts, one), lambda s: s.isNotNull())

    words = w.select("doc_id", F.explode(near).alias("s")).select("doc_id", "s.*")
    fields = words.select("doc_id", "word", "before", "after", F.explode(F.split("whole", FIELDS)).alias("field")).where(F.col("field").rlike(RUN))
    found = fields.select("doc_id", "word", "before", "after", F.explode(let(F.split("field", ENDS), runs)).alias("s")).select("doc_id", "word", "s.candidate", F.concat_ws(" ", "before", "s.name").alias("before"), "after")
    c = F.col("candidate")
    return found.where((c.rlike("[0-9]") & c.rlike("[A-Za-z]") & (F.length(c) >= 16)) | F.col("before").rlike(assigned))


def features(found: DataFrame) -> DataFrame:
    """``found(candidate, before, after)`` with one double column for each feature."""
    c = F.col("candidate")
    n = F.length(c).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / n

    made = {
        "length": n,
        "letter_digit": share(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"),
        "case_turns": share(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "hex_share": share("[0-9a-f]"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(32.0)),
        "longest_run": F.array_max(F.transform(F.regexp_extract_all(F.concat(c, F.lit("!")), F.lit(r"[a-z]+|[^a-z]"), F.lit(0)), lambda x: F.length(x))) / n,
        "coverage": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), "")) / n,
        "slashes": share("/"),
        "dots": share(r"\."),
        "dashes": share("[_-]"),
        "extension": c.rlike(r"\.[A-Za-z]{1,4}$").cast("double"),
        "assigned": F.col("before").rlike(r"[:=]\s*[\"']?\s*$").cast("double"),
        "keyword": F.col("before").rlike(KEYWORDS).cast("double"),
        "benign": F.concat_ws(" ", "before", "after").rlike(BENIGN).cast("double"),
        "known_prefix": c.rlike(r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|AIza|eyJ)").cast("double"),
    }
    return found.withColumns({k: F.coalesce(made[k].cast("double"), F.lit(0.0)) for k in _FEATURES})


#: Plain words of code and prose, from which benign findings are made; none is a piece of the dictionary.
PLAIN = (
    "server handler manager widget parser buffer cache queue worker thread socket client request response header payload session cookie router gateway cluster node shard replica index table column schema query cursor driver plugin module package "
    "garden window kitchen bottle orange purple silver winter summer monday friday london berlin paris madrid quick brown jumps lazy monkey dragon castle bridge forest island planet rocket guitar violin"
).split()


def _benign_word(r: random.Random) -> str:
    return r.choice(PLAIN)


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int, str]]:
    """(candidate, before, after, label, kind): half secrets, half what scanners mistake for them; both under telling names and in prose.

    Benign words come from a list of their own, not from the dictionary that the
    coverage is measured by, so that the forest doesn't learn its own features.
    """
    r = random.Random(seed)
    hexs, base, upper = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567"

    def take(alphabet: str, k: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(k))

    def prose() -> str:
        return " ".join(_benign_word(r) for _ in range(AROUND))

    def named() -> str:
        return f"{_benign_word(r)} {r.choice(['token', 'api_key', 'secret', 'password', 'auth_token', 'access-key', 'client_secret', 'passwd', 'credential'])} {r.choice(['=', ':', '= \"', ': \''])}"

    def camel() -> str:
        return "".join(_benign_word(r).title() for _ in range(r.randint(2, 4)))

    secrets = {
        "aws": (lambda: "AKIA" + take(upper, 16), 0.3), "hex": (lambda: take(hexs, r.choice([32, 40, 64])), 1), "github": (lambda: "ghp_" + take(base[:62], 36), 0.5),
        "base64": (lambda: take(base, r.choice([24, 32, 40, 44])) + r.choice(["", "=", "=="]), 1), "slack": (lambda: f"xoxb-{take(string.digits, 12)}-{take(base[:62], 24)}", 0.5),
        "stripe": (lambda: "sk_live_" + take(base[:62], 24), 0.5), "jwt": (lambda: f"eyJ{take(base[:62], 30)}.{take(base[:62], 40)}", 0.6), "mixed": (lambda: take(base[:62], r.randint(16, 24)), 1),
        "phrase": (lambda: "".join(r.choice([_benign_word(r), take(string.digits, 2), _benign_word(r).title()]) for _ in range(3)) + take(string.digits, 3), 1),
    }
    benign = {
        "commit": (lambda: take(hexs, 40), lambda: f"{_benign_word(r)} {r.choice(['commit', 'revision', 'sha1'])}"), "checksum": (lambda: take(hexs, r.choice([32, 64])), lambda: f"{r.choice(['md5', 'sha256', 'checksum', 'digest'])} :"),
        "uuid": (lambda: "-".join(take(hexs, m) for m in (8, 4, 4, 4, 12)), lambda: f"{_benign_word(r)} {r.choice(['uuid', 'id', 'request'])}"),
        "path": (lambda: "/" + "/".join(_benign_word(r) for _ in range(4)) + str(r.randint(1, 99)) + r.choice([".py", ".txt", ".so", ""]), prose),
        "class": (lambda: camel() + str(r.randint(1, 2024)), prose), "snake": (lambda: "_".join(_benign_word(r) for _ in range(3)) + str(r.randint(1, 9)), prose),
        "masked": (lambda: r.choice("xX0*1") * r.randint(12, 24) + "a1", named), "placeholder": (lambda: f"{r.choice(['your', 'my', 'example', 'changeme'])}_{_benign_word(r)}_here{r.randint(1, 9)}", named),
        "number": (lambda: take(string.digits, r.randint(16, 20)) + r.choice("abc"), lambda: f"{_benign_word(r)} {r.choice(['order', 'invoice', 'ticket'])}"), "host": (lambda: f"{_benign_word(r)}{r.randint(1, 9)}.{_benign_word(r)}.com", named),
        "reference": (lambda: f"{_benign_word(r)}.{r.choice(['config', 'settings', 'env'])}.{_benign_word(r)}{r.randint(1, 9)}", named), "version": (lambda: f"{_benign_word(r)}-{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 9)}-{r.choice(['linux', 'darwin'])}-x86_64", prose),
    }
    out = []
    for k in range(n):
        if k % 2:
            kind = r.choice(sorted(secrets))
            value, told = secrets[kind]
            out.append((value(), named() if r.random() < told else prose(), prose(), 1, kind))
        else:
            kind = r.choice(sorted(benign))
            value, before = benign[kind]
            out.append((value(), before(), prose(), 0, kind))
    return out


def train(spark: SparkSession, labelled: DataFrame | None = None):
    """A forest fitted to ``labelled(candidate, before, after, label)`` (default: the findings above).

    Training rows sit in one partition, which makes bagging, and so the forest, the
    same on every cluster; they are at most ``FINDINGS`` by default.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if labelled is None:
        labelled = spark.createDataFrame(labelled_findings(), "candidate string, before string, after string, label int, kind string")
    rows = features(labelled.coalesce(1)).select(*_FEATURES, F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="_features", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_label")
    # A copy has no training summary: that refers to the session, which can't always be sent to executors.
    return Pipeline(stages=[VectorAssembler(inputCols=list(_FEATURES), outputCol="_features"), forest]).fit(rows).copy()


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, word, candidate, probability, is_secret) of each candidate of each row of ``docs(doc_id, text)``.

    A null or empty text has no candidates; texts are read whole, however long; a
    candidate that stands at several places is several findings, and repeated rows give
    repeated findings; a probability of just ``threshold`` is a secret; other columns
    are ignored; an empty table gives no rows.
    """
    from pyspark.ml.functions import vector_to_array

    model = train(docs.sparkSession, labelled)
    scored = model.transform(features(candidates(docs)))
    p = F.round(vector_to_array("_p")[1], 6)
    return scored.select("doc_id", "word", "candidate", p.alias("probability")).withColumn("is_secret", F.col("probability") >= threshold)
