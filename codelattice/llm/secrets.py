"""Operator 1 [DataFrame only]: secret scan with a random forest that removes false positives.

A pattern proposes candidates. Features of each, all SQL expressions, are its length, the shape of its
characters, the transitions between character classes, how many of its letter pairs are usual in
prose, how much of it a dictionary covers, and what the words beside it and the path say. A random
forest, trained by Spark ML from labelled findings, votes on them. The trained trees are then
written out as one SQL expression and evaluated where the text lies: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_NAMES = "secret|token|passw|pwd|api.?key|auth|credential|private|access.?key|bearer"
#: Proposes a run of 16 or more key characters that has a letter and a digit, or 20 or more capitals, or any 16 after an assignment;
#: and, where a key name is assigned to, any unbroken value of 6 or more characters.
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/-])(?:(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}={0,2}"
    r"|[A-Z]{20,}(?![A-Za-z0-9_+/-])|(?<=[=:] ?[\"'])[A-Za-z0-9_+/-]{16,}={0,2}"
    rf"|(?<=[=:] ?[\"'`]?)(?<=(?i:{KEY_NAMES})[A-Za-z_-]{{0,8}} ?[=:] ?[\"'`]?)[^\s\"'`,;<>(){{}}\[\]]{{6,}})"
)
DICTIONARY = "about after and are been but call can class code data date day default en end est file first for from get has have her his home index into item key last les line list long main make more name new not number of off old one only open order other our out over page path people place point read result run sample set she size some state string table text than that the their them then there they this time type und under use user value was what when which who will with word work world write year you your".split()
PAIRS = "al an ar as at be ca ch ci co ct de di du ea ed el em en er es et eu ge ha he ic ie il im in io is it la le li ll ly ma me mo na nd ne ng nt of ol om on or ou pe po pr qu ra re ri ro rs sa sc se sh si so st ta te th ti to tr ts ui un ur us ut ve vi we wh".split()
FEATURES = ("length", "digits", "upper", "transitions", "pairs", "dictionary", "hex", "distinct", "assigned", "named", "excused", "prefix", "path", "alike")
BEFORE, AFTER = 40, 16
TREES, DEPTH, SEED = 24, 6, 11
MARK = "[SECRET]"
Tree = float | tuple
_TRAINED: dict[tuple, list[Tree]] = {}


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The features, in the order of FEATURES, as doubles; no part may be null."""
    lower, size = F.lower(value), F.length(value)
    last = F.greatest(size - 1, F.lit(1))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    covered = size - F.length(F.regexp_replace(lower, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    near = F.concat(before, F.lit(" "), after)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [x.cast("double") for x in (
        size, (size - F.length(F.regexp_replace(value, "[0-9]", ""))) / size, (size - F.length(F.regexp_replace(value, "[A-Z]", ""))) / F.greatest(letters, F.lit(1)),
        (runs - 1) / last, F.regexp_count(lower, F.lit("(?=" + "|".join(PAIRS) + ")")) / last, covered / size, flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        F.size(F.array_distinct(F.split(value, ""))) / size, flag(before.rlike(r"[=:]\s?[\"'`]?$")),
        flag(before.rlike(rf"(?i)({KEY_NAMES})[^\n]{{0,16}}$")),
        flag(near.rlike(r"(?i)(example|dummy|placeholder|changeme|commit|sha-?\d|md5|checksum|digest|etag|uuid|guid|revision|integrity)")),
        flag(value.rlike("^(AKIA|ASIA|gh[pousr]_|github_pat_|sk[-_]|xox[abp]-|eyJ|AIza|glpat-)")),
        flag(path.rlike(r"(?i)(test|example|fixture|sample|docs?/|mock)")), flag(value.rlike(r"(.)\1{5}|0123456|1234567|abcdefg")),
    )]


def labelled_findings(spark: SparkSession, n: int = 7_200) -> DataFrame:
    """value, before, after, path, label, format: findings as a reviewer would have marked them, made from a rule.

    Secrets are random keys and passwords of usual formats where code or text assigns them; false positives are
    digests, identifiers, long words, encoded data, samples, placeholders and ids of the same lengths.
    """
    h = lambda k, size: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256), 1, size)
    b64 = lambda k, size: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 512))), "=", ""), 1, size)
    pick = lambda k, *options: F.element_at(F.array(*map(F.lit, options)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(options))).cast("int") + 1)
    caps = lambda k, size: F.upper(F.translate(b64(k, size), "+/abcdefghij", "QXKLMNPQRSTU"))
    word = lambda k: pick(k, *[a + b for a in ("th", "on", "er", "tion", "ing", "re", "con", "ver", "lich", "ment", "que", "ción", "an", "ste") for b in ("al", "ed", "en", "it", "ou", "es", "in", "at", "er")])
    plain = lambda k: pick(k, *[w for w in DICTIONARY if len(w) > 2])
    long_word = F.regexp_replace(F.concat(*[word(f"w{i}") for i in range(6)]), "[^A-Za-z]", "o")
    camel = F.concat(*[F.initcap(pick(f"c{i}", "get", "user", "index", "handler", "default", "value", "request", "render", "table", "manager", "service")) for i in range(4)], F.pmod("id", F.lit(90)).cast("string"))
    key = pick("key", "token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret")
    prose = F.concat_ws(" ", pick("mark", "", "", "", "#", "*", "-", "//", "$"), *[plain(f"l{i}") for i in range(3)], F.lit(""))
    given = F.concat(F.when(F.pmod(F.xxhash64("id", F.lit("lead")), F.lit(3)) == 0, prose).otherwise(pick("lead2", "", "config: ", "export ", "set ", "  ")), key, pick("op", "=", " = ", ": ", '="', ' = "', ': "', "="))
    mixed = lambda k, size: F.translate(b64(k, size), "+/", "!@")
    rows = [
        ("hex40", 1, h("a", 40), given), ("hex18", 1, h("b", 18), given), ("hex32", 1, h("c", 32), given), ("hex24", 1, h("q", 24), given), ("base40", 1, b64("d", 40), given), ("base24", 1, b64("e", 24), given), ("base20", 1, b64("t", 20), given),
        ("akia", 1, F.concat(F.lit("AKIA"), caps("f", 16)), prose), ("akia given", 1, F.concat(F.lit("AKIA"), caps("r", 16)), given), ("ghp", 1, F.concat(F.lit("ghp_"), b64("g", 36)), pick("gp", "token ", "url ", "=", "")),
        ("sk", 1, F.concat(F.lit("sk-"), b64("h", 32)), pick("sp", "key ", "= ", "")), ("jwt", 1, F.concat(F.lit("eyJ"), b64("i", 48)), pick("jp", "Bearer ", "Authorization: ", "jwt=")),
        ("password", 1, mixed("pw", 10), given), ("word password", 1, F.concat(F.initcap(plain("pv")), h("px", 4), pick("pz", "!", "$", "x9", "Q", "#1", ".K")), given), ("dotted", 1, F.concat_ws(".", mixed("da", 7), mixed("db", 9)), given),
        ("commit", 0, h("j", 40), pick("git", "commit ", "sha1 ", "revision: ", "merged in commit ")), ("digest", 0, h("k", 64), pick("sum", "sha256: ", "sha-256=", "checksum = ", "integrity: ")), ("md5", 0, h("l", 32), pick("md", "md5: ", "etag: ", "digest=")),
        ("uuid", 0, F.concat_ws("-", h("m", 8), h("n", 4), h("o", 4), h("p", 12)), pick("id", "uuid: ", "id ", "guid = ")), ("camel", 0, camel, pick("cc", "def ", "class ", "= ", "import ", "the ")),
        ("long word", 0, long_word, prose), ("long capitals", 0, F.upper(long_word), prose), ("numbered word", 0, F.concat(long_word, F.pmod("id", F.lit(100)).cast("string")), prose),
        ("example", 0, F.concat(F.lit("EXAMPLE"), h("s", 20)), F.concat(F.lit("example "), given)), ("repeated", 0, F.concat(F.lit("aaaaaaaa"), F.lit("00000000"), h("u", 4)), given),
        ("slug", 0, F.concat_ws("-", *[word(f"s{i}") for i in range(4)], F.pmod("id", F.lit(30)).cast("string")), pick("slug", "/", "url: ", "href=")), ("path", 0, F.concat_ws("/", word("p1"), word("p2"), h("v", 6), word("p3")), pick("pp", "path ", "from ", "open ")),
        ("build", 0, F.concat(F.lit("v"), F.pmod("id", F.lit(20)).cast("string"), F.lit("_release_build_"), F.pmod("id", F.lit(977)).cast("string")), prose),
        ("plain word", 0, F.concat(plain("qa"), plain("qb"), pick("qc", "", ".", "s", "ed", "ing")), given), ("placeholder", 0, pick("ph", "required", "changeme", "undefined", "optional", "$PASSWORD", "$TOKEN", "os.environ", "process.env", "********", "xxxxxxxx", "string", "hidden", "nullable", "example"), given),
        ("attribute", 0, F.concat_ws(".", plain("ra"), plain("rb"), plain("rc")), given), ("long slug", 0, F.concat_ws("-", plain("ta"), plain("tb"), plain("tc"), plain("td")), given),
    ]
    base = spark.range(n, numPartitions=1)
    kind = F.pmod("id", F.lit(len(rows)))
    columns = []
    for i, name in ((0, "format"), (1, "label"), (2, "value"), (3, "before")):
        out = F.lit(None)
        for k, row in enumerate(rows):
            out = F.when(kind == k, F.lit(row[i]) if not isinstance(row[i], Column) else row[i]).otherwise(out)
        columns.append(out.alias(name))
    return base.select(*columns, pick("after", '"', " ", "", "\n", ";", ".", ",").alias("after"), pick("path", "web", "forum", "web/app.py", "conf/settings.yaml", "notes.md", "tests/data.txt").alias("path"))


def train(spark: SparkSession, labelled: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Tree]:
    """The trees of a forest that votes 1 for a secret, 0 for none.

    labelled: value, before, after, path, label (1 or 0); by default labelled_findings(). Rows with a
    null value or label don't count. Training is on one partition, so that it gives the same trees
    on any cluster; findings are reviewed by people and few.
    """
    if labelled is None and (trees, depth, seed) in _TRAINED:
        return _TRAINED[trees, depth, seed]
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled if labelled is not None else labelled_findings(spark)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("value", "before", "after", "path")]
    rows = rows.where("value is not null and length(value) > 0 and label in (0, 1)").select(*[x.alias(n) for x, n in zip(features(*parts), FEATURES)], F.col("label").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        raise ValueError("labelled findings of both kinds are needed")
    frame = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label").coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(frame)
    out = [tree_of(t.toDebugString) for t in model.trees]
    if labelled is None:
        _TRAINED[trees, depth, seed] = out
    return out


def tree_of(text: str) -> Tree:
    """A tree's description, as Spark ML prints it: (feature, bound, tree up to it, tree above), or a vote."""
    lines = iter([x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)])

    def node() -> Tree:
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        test = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        yes = node()
        next(lines)
        return int(test[1]), float(test[2]), yes, node()

    return node()


def votes(f: Column, trees: list[Tree]) -> Column:
    """The mean vote of the trees on a struct with fields f0, f1, ..."""

    def node(tree: Tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        feature, bound, yes, no = tree
        return F.when(f[f"f{feature}"] <= bound, node(yes)).otherwise(node(no))

    total = node(trees[0])
    for tree in trees[1:]:
        total = total + node(tree)
    return total / len(trees)


def found(text: Column, path: Column, trees: list[Tree], least: float) -> Column:
    """An array of value, start (from 0), times, probability: the distinct secrets of a text, by their first place.

    Every match is judged beside its own neighbours; a value is a secret if any of its matches is voted one, and has the probability of the first such match.
    """
    safe, site = F.coalesce(text, F.lit("")), F.coalesce(path, F.lit(""))
    bound = lambda c, f: F.flatten(F.transform(F.array(c), f))  # noqa: E731  # f of c, which is evaluated once

    def seen(parts: Column) -> Column:
        """The matches and what is around them: parts of the text between matches, and matches. A match and the part before it have 10 characters at least, so that four of both span BEFORE, and two AFTER."""
        match, gap = lambda i: F.get(parts["matches"], i), lambda i: F.get(parts["gaps"], i)

        def one(v: Column, i: Column) -> Column:
            before = F.right(F.concat_ws("", match(i - 4), gap(i - 3), match(i - 3), gap(i - 2), match(i - 2), gap(i - 1), match(i - 1), gap(i)), F.lit(BEFORE))
            after = F.substring(F.concat_ws("", gap(i + 1), match(i + 1), gap(i + 2), match(i + 2)), 1, AFTER)
            return F.struct(v.alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(parts["matches"], one)

    sites = bound(F.struct(F.regexp_extract_all(safe, F.lit(CANDIDATE), F.lit(0)).alias("matches"), F.split(safe, CANDIDATE, -1).alias("gaps")), seen)
    described = F.transform(sites, lambda c: F.struct(c["value"].alias("value"), *[x.alias(f"f{i}") for i, x in enumerate(features(c["value"], c["before"], c["after"], site))]))
    judged = F.transform(described, lambda f: F.struct(f["value"].alias("value"), votes(f, trees).alias("probability")))
    kept = F.filter(judged, lambda s: s["probability"] >= least)
    times = lambda v: F.floor((F.length(safe) - F.length(F.replace(safe, v, F.lit("")))) / F.length(v))

    def secret(names: Column, probabilities: Column) -> Column:
        return F.transform(F.array_distinct(names), lambda v: F.struct(
            (F.call_function("locate", v, safe) - 1).cast("long").alias("start"), v.alias("value"), times(v).cast("long").alias("times"),
            F.get(probabilities, (F.array_position(names, v) - 1).cast("int")).alias("probability"),
        ))

    lists = F.struct(F.transform(kept, lambda s: s["value"]).alias("names"), F.transform(kept, lambda s: s["probability"]).alias("probabilities"))
    return F.array_sort(bound(lists, lambda k: secret(k["names"], k["probabilities"])))


def scan(docs: DataFrame, path: str = "source", least: float = 0.5, trees: list[Tree] | None = None) -> DataFrame:
    """doc_id, start, length, times, probability, sha256: one row for each distinct secret of each text.

    start counts characters from 0 to the first occurrence, times counts occurrences. Null and empty
    texts have none; a null doc_id or path is kept as it is; repeated rows are scanned each; an empty table gives an empty result;
    other columns are dropped.
    """
    trees = trees or train(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(found(F.col("text").cast("string"), F.col(path).cast("string"), trees, least)).alias("s"))
    return rows.select("doc_id", "s.start", F.length("s.value").cast("long").alias("length"), "s.times", "s.probability", F.sha2(F.col("s.value"), 256).alias("sha256"))


def redact(docs: DataFrame, path: str = "source", least: float = 0.5, mark: str = MARK, trees: list[Tree] | None = None) -> DataFrame:
    """docs with every occurrence of a secret in text replaced by the mark; all rows and columns stay, n_chars follows where it is a column."""
    trees = trees or train(docs.sparkSession)
    text = F.col("text").cast("string")
    values = F.transform(found(text, F.col(path).cast("string"), trees, least), lambda s: s["value"])
    longest = F.array_sort(values, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    clean = F.aggregate(longest, text, lambda t, v: F.replace(t, v, F.lit(mark)))
    out = docs.withColumn("text", clean)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns]) if "n_chars" in docs.columns else out
