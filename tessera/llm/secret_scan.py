r"""Secret scans in DataFrame functions only: patterns pick candidates, a random forest removes false positives.

Features of a candidate are its length, character transitions, dictionary coverage, the path it lies in, and the
words beside it.  The forest learns from labelled findings; ``labelled_findings`` makes a set of them from known
formats, and any table of the same columns can take its place.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters on either side of a candidate that are looked at.
CONTEXT = 48
#: Hits of a text whose lengths are added up at once.
RUN_HITS = 256
#: Rows that labelled_findings makes: the bound of the forest's training set.
FINDINGS = 3600
TREES, DEPTH = 24, 7

# Words that name secrets, words that name harmless values, dictionary, providers' formats.
SECRET_WORDS = "token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key"
HARMLESS_WORDS = "commit|sha1|sha256|sha512|md5|checksum|digest|hash|uuid|guid|revision|version|example|sample|dummy|placeholder|integrity|etag|image|font|build|serial|order|invoice"
DICTIONARY = (
    "access account action admin after api array auth base binary body build button cache change check class client cloud code config content count create "
    "data date default delete demo docs document download error event example false field file filter find first folder font from function get goes group "
    "handler hash header here home host http icon image index input insert item java json key label last library license list local log login main manager "
    "message model module my name number object order package page param password path place python query read release request response sample script search "
    "secret section select server service session set site size source start state static string style system table test text this time title token true type "
    "update upload url user value vendor version view web window with word world write your"
)
PROVIDERS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+|github_pat_[0-9A-Za-z_]{22,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{35}|[sr]k_live_[0-9A-Za-z]{16,}+|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+|-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"
ASSIGNED = rf"(?i:{SECRET_WORDS})[\"']?[ \t]{{0,4}}(?:=>|:=|[:=])[ \t]{{0,4}}[\"']?"
RUN = r"A-Za-z_+/=-"
#: A value given to a secret's name, a provider's format, or a long run that holds a digit; of any length.  A run whose
#: first digit is far off leaves a name with its value, or a provider's format, within it to be found by itself.
CANDIDATE = (
    rf"{ASSIGNED}[^\s\"']{{8,}}+|{PROVIDERS}"
    rf"|(?<![0-9{RUN}])(?:(?=[{RUN}]{{0,64}}[0-9])|(?=[{RUN}]*+[0-9])(?![0-9{RUN}]*?(?:{ASSIGNED}[^\s\"']{{8}}|{PROVIDERS})))[0-9{RUN}]{{16,}}+"
)
#: What is no part of a value at its end.
TAIL = r"(?<![.,;:!?*#$%&)\]}])[.,;:!?*#$%&)\]}]++$"
HARMLESS_PATHS = r"(?i)(?:^|[/\\._-])(?:tests?|specs?|fixtures?|examples?|samples?|docs?|vendor|node_modules|locales?|lock)(?:[/\\._-]|$)"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """doc_id, path, start, value, before, after: every candidate of every text, in one pass without a shuffle."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).withColumn("gaps", F.split("text", CANDIDATE, -1))
    # a hit starts after the gaps up to its own and the hits before it
    size = F.transform("hits", lambda h, i: F.length(h) + F.length(F.get("gaps", i)))
    rows = rows.select("doc_id", "path", "hits", "gaps", size.alias("size")).where(F.size("hits") > 0)
    # a running sum in runs of RUN_HITS hits, so that many hits in one text do not cost their square
    add = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, s: a + s)
    runs = F.transform(F.sequence(F.lit(0), F.size("size") - 1, F.lit(RUN_HITS)), lambda k: add(F.slice("size", k + 1, RUN_HITS)))
    rows = rows.withColumn("base", F.aggregate(runs, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s))))
    begin = lambda i: F.get("base", F.floor(i / RUN_HITS).cast("int")) + add(F.slice("size", F.floor(i / RUN_HITS).cast("int") * RUN_HITS + 1, i % RUN_HITS))
    hit = F.transform(
        "hits",
        lambda h, i: F.struct(
            (begin(i) + F.length(F.get("gaps", i))).alias("start"),
            h.alias("hit"),
            F.right(F.get("gaps", i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )
    rows = rows.select("doc_id", "path", F.explode(hit).alias("h")).select("doc_id", "path", "h.*")
    name = F.regexp_extract("hit", rf"^{ASSIGNED}", 0)
    rows = rows.withColumn("name", name)
    return rows.select(
        "doc_id",
        "path",
        (F.col("start") + F.length("name")).alias("start"),
        F.regexp_replace(F.expr("substring(hit, length(name) + 1)"), TAIL, "").alias("value"),
        F.concat("before", "name").alias("before"),
        "after",
    )


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """The forest's input, an array of doubles."""
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda pattern: (n - F.length(F.regexp_replace(value, pattern, ""))) / n
    runs = lambda shape: (F.length(F.regexp_replace(shape, r"(.)\1*", "$1")) - 1) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"[^0-9A-Za-z]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    voiced = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z]", "-"), "[aeiouy]", "A"), "[a-z]", "b")
    dictionary = "|".join(sorted((w for w in DICTIONARY.split() if len(w) > 2), key=lambda w: (-len(w), w)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return F.array(
        F.length(value).cast("double"),
        runs(kinds),
        runs(voiced),
        share("[0-9]"),
        share("[A-Z]"),
        share("[^0-9A-Za-z]"),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64)),
        share(f"(?i:{dictionary})"),
        flag(value.rlike(r"^[0-9a-fA-F]+$")),
        flag(value.rlike(rf"^(?:{PROVIDERS})")),
        flag(value.rlike(r"/.*/|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-") | before.rlike(r"(?:://\S*|/)$")),
        flag(path.rlike(HARMLESS_PATHS)),
        flag(before.rlike(rf"(?i)(?:{SECRET_WORDS})[^\n]{{0,16}}$")),
        flag(before.rlike(r"[:=>]\s*[\"']?$")),
        flag(before.rlike(rf"(?i)(?:^|[^a-z])(?:{HARMLESS_WORDS})[^a-z\n]{{0,8}}$") | after.rlike(rf"(?i)^[^a-z\n]{{0,8}}(?:{HARMLESS_WORDS})(?:[^a-z]|$)")),
    )


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """value, before, after, path and label (1: a secret), from known formats and a hash of the row's number."""
    t = spark.range(0, rows, 1, 4).selectExpr("id", "id % 18 as kind", "sha2(cast(id as string), 256) as h", "sha2(concat('u', id), 256) as g", "translate(base64(unhex(sha2(concat('b', id), 512))), '+/=\\n', 'xYz') as b", "id div 18 as n")
    words = "array('" + "','".join(DICTIONARY.split()) + "')"
    word = lambda k: f"element_at({words}, 1 + cast(pmod(xxhash64(id, {k}), {len(DICTIONARY.split())}) as int))"
    value = f"""case kind
        when 0 then left(h, 40) when 1 then left(h, 32 + cast(n % 3 as int) * 16) when 2 then left(b, 24 + cast(n % 40 as int))
        when 3 then concat('AKIA', left(upper(translate(b, 'xYz', 'QRS')), 16)) when 4 then concat('ghp_', left(b, 36))
        when 5 then concat('eyJ', left(b, 20), '.eyJ', left(g, 30), '.', right(b, 30)) when 6 then concat(left(b, 8), '!', right(b, 4 + cast(n % 9 as int)))
        when 7 then upper(left(h, 40)) when 8 then left(b, 32)
        when 9 then left(h, 40) when 10 then h when 11 then concat_ws('-', left(h, 8), left(g, 4), substr(g, 5, 4), substr(g, 9, 4), left(g, 12))
        when 12 then concat_ws(element_at(array('-', '_', ''), 1 + cast(n % 3 as int)), {word(1)}, {word(2)}, {word(3)}, {word(4)}, cast(n % 100 as string))
        when 13 then concat('usr/', {word(1)}, '/', {word(2)}, cast(n % 10 as string), '/', {word(3)}, '_', {word(4)})
        when 14 then element_at(array(repeat('x', 8 + cast(n % 30 as int)), repeat('0', 16), '1234567890123456', repeat('abcd1234', 3), repeat('*', 12), concat({word(1)}, {word(2)})), 1 + cast(n % 6 as int))
        when 15 then concat({word(1)}, initcap({word(2)}), initcap({word(3)}), initcap({word(4)}), cast(n % 10 as string))
        when 16 then left(translate(h, 'abcdef', '123456'), 16 + cast(n % 12 as int))
        else concat({word(1)}, '-', {word(2)}, '-', {word(3)}, '-', left(translate(h, 'abcdef', '123456'), 6)) end"""
    name = "element_at(array('token = \"', 'api_key: ', 'secret=', 'password = \"', 'TOKEN = \"', 'access_key=\"', 'Authorization: Bearer '), 1 + cast(pmod(xxhash64(id, 9), 7) as int))"
    before = f"""case when kind in (0, 1, 2, 6, 7, 8) then concat({word(5)}, ' ', {name}) when kind in (3, 4, 5) then if(n % 2 = 0, {name}, concat({word(5)}, ' '))
        when kind in (9, 10) then concat({word(5)}, ' ', element_at(array('commit ', 'sha256: ', 'checksum = ', 'md5 ', 'revision ', 'digest: ', 'integrity=\"'), 1 + cast(n % 7 as int)))
        when kind = 11 then element_at(array('uuid: ', 'id = \"', 'guid='), 1 + cast(n % 3 as int)) when kind in (12, 14) then if(n % 3 = 0, concat({word(6)}, ' '), {name})
        when kind = 13 then if(n % 2 = 0, 'see /', 'https://host/') when kind = 17 then 'https://host/' else concat({word(6)}, ' ', {word(7)}, ' ') end"""
    path = "element_at(array('src/main', 'tests/unit', 'app', 'docs/guide', 'lib', cast(null as string)), 1 + cast(if(kind < 9, pmod(xxhash64(id, 11), 3) * 2, pmod(xxhash64(id, 11), 6)) as int))"
    return t.selectExpr(f"{value} as value", f"{before} as before", "if(n % 2 = 0, '\" and', ' or') as after", f"{path} as path", "cast(if(kind < 9, 1, 0) as double) as label")


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> RandomForestClassificationModel:
    """A random forest on labelled findings (value, before, after, path, label)."""
    rows = findings.select(array_to_vector(features(*(F.col(c) for c in ("value", "before", "after", "path")))).alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def scored(found: DataFrame, forest: RandomForestClassificationModel) -> DataFrame:
    """found with a column score: the forest's share for a secret."""
    rows = found.withColumn("features", array_to_vector(features(*(F.col(c) for c in ("value", "before", "after", "path")))))
    return forest.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan_secrets(docs: DataFrame, forest: RandomForestClassificationModel, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per secret: doc_id, start and end (characters), rule, shown (its first four characters),
    sha256 (of the value) and score, for candidates that the forest gives ``least`` or more.

    Null and empty texts hold none.  Repeated rows report each; a null id is reported as null; a null path is no
    path.  Secrets of any number and length within a text are found.  Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = scored(candidates(docs, id_col, text_col, path_col).where("length(value) >= 8"), forest).where(F.col("score") >= least)
    rule = F.when(F.col("value").rlike(rf"^(?:{PROVIDERS})"), "provider").when(F.col("before").rlike(rf"{ASSIGNED}$"), "assigned").otherwise("run")
    return rows.select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        (F.col("start") + F.length("value")).cast("long").alias("end"),
        rule.alias("rule"),
        F.left("value", F.lit(4)).alias("shown"),
        F.sha2("value", 256).alias("sha256"),
        "score",
    )
