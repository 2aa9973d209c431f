"""Secret scans: candidates by expression, false positives removed by a random forest.

The forest looks at a candidate's length, character transitions, dictionary coverage, the
document's path and the neighbouring words.  It is trained from labelled findings and compiled
to a SQL expression, so scanning, scoring and redaction run inside one native projection: no
Python, no join, no shuffle.

Scale: row-local; the model is an expression of fixed size.  Training reads the labelled
findings only (a bounded table, by default one made from a rule).

What is proposed decides what can be found: see ``CANDIDATE``.  A password that is not assigned to
a telling name, or is shorter than six characters, is not proposed.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TREES = 21
DEPTH = 5
NEAR = 40
THRESHOLD = 0.5
PLACEHOLDER = "[SECRET]"

#: A name that secrets are assigned to, up to the value; the name may end a longer one (DB_PASSWORD).
KEYED = r"""(?i:passw(?:or)?d|pwd|secret|token|api.?key|access.?key|private.?key|credential)s?["']? ?[=:] ?["']?"""

#: Candidates: private key blocks; signed tokens of parts joined by dots; values of six characters at least assigned
#: to a telling name; issued access keys; and runs of 16 token characters at least with a digit and a letter.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++){1,2}"
    rf"|{KEYED}[^\s\"'<>,;]{{5,}}[^\s\"'<>,;.)]"
    r"|(?<![A-Za-z0-9+/_-])(?:(?:AKIA|ASIA)[A-Z0-9]{12,}+(?![A-Za-z0-9+/_-])|(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+)"
)

#: Words whose presence inside a candidate speaks for an identifier or a placeholder.
DICTIONARY = (
    "account action active address admin alpha api app article asset auth author backup batch beta block blog body book build button cache card cart case category change channel chapter "
    "check city class client cloud code color column comment commit company config content context copy count country create current custom data date debug default delete demo detail dev "
    "device document domain download draft dummy edit email entry error event example export feature field file filter first folder font form format from global group guide handler header "
    "here home html http icon id image import index info input insert internal invoice issue item job key label language last layout level library link list load local log login main manager "
    "map media member menu message method model module month name network news node note number object old online order page param part pass path payment period phone photo picture place "
    "placeholder plan player plugin point policy post preview price private process product profile project public query record region release remote report request resource response result "
    "review role route row rule sample save schema score script search section server service session setting shop site size source staging start state static status step store string style "
    "summary system table tag target task team template test text theme ticket time title token topic track type unit update upload user util value version video view web week widget window "
    "work year your"
).split()

#: Neighbouring words for and against, prefixes that issuers use, paths of test material.
FOR_WORDS = r"(password|passwd|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|private.?key|client.?secret)"
AGAINST_WORDS = r"(?<![a-z0-9.@-])(commit|sha1|sha256|sha512|md5|checksum|digest|integrity|etag|uuid|guid|hash|revision|example|placeholder|dummy|sample|build|version|request.?id|trace)(?![a-z0-9.@-])"
ISSUED = r"^(-----BEGIN|AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ|glpat-|npm_|SG)"
TEST_PATH = r"(?i)(^|[/_.-])(test|tests|spec|fixture|fixtures|example|examples|sample|mock|docs?)([/_.-]|$)"

#: Feature names with the SQL that computes each from a candidate ``c`` (value, before, after, path).
FEATURES = {
    "length": "length(c.value)",
    "transitions": "regexp_count(c.value, '(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])') / length(c.value)",
    "letter_runs": "length(regexp_replace(c.value, '[A-Za-z]{3,}', '')) / length(c.value)",
    "digits": "length(regexp_replace(c.value, '[^0-9]', '')) / length(c.value)",
    "distinct": "size(array_distinct(split(c.value, ''))) / least(length(c.value), 36)",
    "separators": "length(regexp_replace(c.value, '[^_/-]', '')) / length(c.value)",
    "repeats": "regexp_count(c.value, '(.)(?=\\\\1)') / length(c.value)",
    "hex": "cast(c.value rlike '^([0-9a-f]+|[0-9A-F]+)$' as double)",
    "dictionary": f"1 - length(regexp_replace(lower(c.value), '({'|'.join(sorted(DICTIONARY, key=len, reverse=True))})', '')) / length(c.value)",
    "issued": f"cast(c.value rlike '{ISSUED}' as double)",
    "said_example": "cast(upper(c.value) rlike 'EXAMPLE|CHANGEME|YOUR|XXXX|1234567|DUMMY|SAMPLE' as double)",
    "words_for": f"cast(c.before rlike '{FOR_WORDS}' as double)",
    "words_against": f"cast(c.before rlike '{AGAINST_WORDS}' or c.after rlike '{AGAINST_WORDS}' as double)",
    "assigned": "cast(c.before rlike '[=:] ?[\"'']?$' as double)",
    "test_path": f"cast(c.path rlike '{TEST_PATH}' as double)",
}


def _sql(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _feature_sql() -> dict[str, str]:
    return {k: f"cast({v} as double)" for k, v in FEATURES.items()}


def labelled_findings(spark: SparkSession, n: int = 10_500) -> DataFrame:
    """value, before, after, path, label: findings made from a rule, standing in for a labelled table.

    Secrets are random keys as issuers or configurations write them; the others are commit ids,
    checksums, UUIDs, identifiers, slugs, placeholders, and keys below test paths.
    """
    word = lambda k: f"element_at(array({', '.join(repr(w) for w in DICTIONARY)}), cast(1 + pmod(xxhash64(id, {k}), {len(DICTIONARY)}) as int))"
    plain = "translate(sha2(concat('w', id), 256), '0123456789', 'aeiounrtsl')"
    one_of = lambda values, k=0: f"element_at(array({', '.join(repr(v) for v in values)}), cast(1 + pmod(xxhash64(id, {k}), {len(values)}) as int))"
    any_word = f"concat(substring({plain}, 1, 5), ' ', substring({plain}, 9, 7), ' ')"
    random36 = "regexp_replace(base64(unhex(sha2(concat('r', id), 256))), '[+/=]', 'q')"
    hex40, hex32 = "sha1(cast(id as string))", "md5(cast(id as string))"
    kinds = [
        (f"{hex40}", "'token = \"'", 1),
        (f"substring({hex32}, 1, cast(16 + pmod(id, 9) as int))", "'password='", 1),
        ("concat('AKIA', translate(upper(substring(sha1(cast(id as string)), 1, 16)), '0189', 'QZKX'))", any_word, 1),
        (f"concat('ghp_', substring({random36}, 1, 36))", any_word, 1),
        (f"substring({random36}, 1, cast(24 + pmod(id, 18) as int))", "'secret: '", 1),
        (f"concat('sk_live_', substring({random36}, 1, 24))", "'api_key = '", 1),
        (f"substring({random36}, 1, 40)", "'aws access key '", 1),
        (hex40, "element_at(array('commit ', 'git sha1 ', 'revision ', 'at commit '), cast(1 + pmod(xxhash64(id), 4) as int))", 0),
        (f"concat_ws('-', substring({hex32}, 1, 8), substring({hex32}, 9, 4), substring({hex32}, 13, 4), substring({hex32}, 17, 4), substring({hex32}, 21, 12))", "element_at(array('uuid ', 'request id ', 'guid: ', 'trace '), cast(1 + pmod(xxhash64(id), 4) as int))", 0),
        (f"concat_ws('_', {word(1)}, {word(2)}, {word(3)}, {word(4)}, cast(pmod(id, 2030) as string))", any_word, 0),
        ("concat(element_at(array('your-api-key-here-', 'xxxxxxxxxxxxxxxx', 'CHANGEME-1234567', 'EXAMPLE_TOKEN_12', 'dummy-secret-key-'), cast(1 + pmod(xxhash64(id), 5) as int)), cast(pmod(id, 100) as string))", "element_at(array('api_key = ', 'password=', 'token: ', 'secret = \"'), cast(1 + pmod(xxhash64(id, 3), 4) as int))", 0),
        (f"concat_ws('-', cast(2000 + pmod(id, 25) as string), '11', '02', {word(5)}, {word(6)}, {word(7)})", any_word, 0),
        (f"sha2(cast(id as string), 256)", "element_at(array('sha256:', 'checksum ', 'integrity sha512-', 'etag: \"', 'md5 '), cast(1 + pmod(xxhash64(id), 5) as int))", 0),
        (hex40, "'token = \"'", 2),
        (f"concat(substring({random36}, 1, 5), {one_of(('!', '@', '#', '.', '$', '%'))}, substring({random36}, 6, cast(2 + pmod(id, 7) as int)))", one_of(("password=", "pwd: ", 'secret = "', "db_password = "), 4), 1),
        (f"concat('-----BEGIN PRIVATE KEY-----\\n', {random36}, {random36}, '\\n-----END PRIVATE KEY-----')", any_word, 1),
        (f"concat('eyJ', substring({random36}, 1, 20), '.eyJ', substring({random36}, 3, 30), '.', substring({random36}, 2, 36))", any_word, 1),
        ("concat('AKIA', translate(upper(substring(sha1(cast(id as string)), 1, 16)), '0123456789', 'GHJKLMPQRS'))", any_word, 1),
        (f"concat(substring({plain}, 1, cast(6 + pmod(id, 9) as int)), {one_of(('', '.x', '-x', ':x'))})", one_of(("password: ", "token: ", "secret: ", "credentials: "), 5), 0),
        (f"concat({word(1)}, {one_of(('.', '_', '-', ''))}, {word(2)}, {one_of(('', '()', '.value', '_id'), 6)})", one_of(("password=", "token = ", "api_key: ", "secret="), 5), 0),
        (f"concat({word(1)}, '/', {word(2)}, '/', {word(3)}, '-', cast(pmod(id, 999) as string), '/', {word(4)})", any_word, 0),
    ]
    case = lambda c: "case pmod(id, %d) %s end" % (len(kinds), " ".join(f"when {k} then {x[c]}" for k, x in enumerate(kinds)))
    rows = spark.range(n).selectExpr(f"{case(0)} as value", f"concat({any_word}, {case(1)}) as before", f"{any_word} as after", f"{case(2)} as kind", "id")
    return rows.selectExpr("value", "lower(before) as before", "after", "case when kind = 2 then 'repo/tests/fixtures/keys.txt' when pmod(id, 3) = 0 then 'src/main/app.py' when pmod(id, 3) = 1 then 'src0' else '' end as path", "cast(kind = 1 as int) as label")


def with_features(findings: DataFrame) -> DataFrame:
    packed = findings.withColumn("c", F.struct("value", "before", "after", "path"))
    return packed.select("*", *[F.expr(v).alias(k) for k, v in _feature_sql().items()]).drop("c")


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> str:
    """The share of trees that vote for a secret, as SQL over a struct ``c`` holding the features."""
    names = list(FEATURES)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(with_features(findings)).select("features", F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.5").fit(rows)
    votes = [_tree_sql(t.toDebugString, names) for t in model.trees]
    return "(" + " + ".join(votes) + f") / {float(len(votes))}D"


def _tree_sql(shown: str, names: list[str]) -> str:
    lines = [line.strip() for line in shown.splitlines()[1:] if line.strip()]

    def node(at: int) -> tuple[str, int]:
        if lines[at].startswith("Predict:"):
            return f"{float(lines[at].split(':')[1])}D", at + 1
        feature, limit = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", lines[at]).groups()
        low, after = node(at + 1)
        high, after = node(after + 1)  # the line between says Else
        return f"(case when c.{names[int(feature)]} <= {float(limit)!r}D then {low} else {high} end)", after

    return node(0)[0]


def scored_candidates(docs: DataFrame, forest: str, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``docs`` with ``__found``: array of (gap, match, value, start, kind, score) in text order, and ``__rest``.

    ``gap`` is the text since the match before, ``match`` the value after the name it is assigned to, if any;
    ``__rest`` is the text after the last match.  Neighbouring words are those of the gaps on either
    side.  Null text counts as empty.  A lambda reads its own element only, never another column:
    Catalyst may put that column's expression in its place, and it would run once an element.
    """
    pattern, key = _sql(CANDIDATE), _sql(KEYED)
    path = f"coalesce(cast(`{path_col}` as string), '')" if path_col else "''"
    rows = docs.withColumn("__text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = rows.withColumn("__m", F.expr(f"regexp_extract_all(__text, '{pattern}', 0)"))
    rows = rows.withColumn("__g", F.expr(f"case when size(__m) = 0 then array(__text) else split(__text, '{pattern}', -1) end"))
    rows = rows.withColumn("__gap", F.expr("slice(__g, 1, size(__m))")).withColumn("__next", F.expr("slice(__g, 2, size(__m))")).withColumn("__rest", F.element_at("__g", -1))
    starts = "aggregate(arrays_zip(__gap, __m), named_struct('p', 0, 's', cast(array() as array<int>)), (a, z) -> named_struct('p', a.p + length(z.__gap) + length(z.__m), 's', concat(a.s, array(a.p + length(z.__gap)))), a -> a.s)"
    rows = rows.withColumn("__s", F.expr(starts)).withColumn("__p", F.array_repeat(F.expr(path), F.size("__m")))
    rows = rows.withColumn("__z", F.expr("arrays_zip(__gap, __m, __next, __s, __p)"))
    rows = rows.withColumn("__v", F.expr(f"transform(__z, z -> named_struct('z', z, 'value', regexp_replace(z.__m, '^{key}', '')))"))
    named = "length(v.z.__m) - length(v.value)"
    before = f"lower(substring(concat(substring(v.z.__gap, -{NEAR}, {NEAR}), substring(v.z.__m, 1, {named})), -{NEAR}, {NEAR}))"
    fields = f"'gap', v.z.__gap, 'match', v.z.__m, 'value', v.value, 'start', v.z.__s + {named}, 'before', {before}, 'after', lower(substring(v.z.__next, 1, {NEAR})), 'path', v.z.__p"
    rows = rows.withColumn("__c", F.expr(f"transform(__v, v -> named_struct({fields}))"))
    fields = ", ".join(f"'{k}', {v}" for k, v in _feature_sql().items())
    rows = rows.withColumn("__f", F.expr(f"transform(__c, c -> named_struct('gap', c.gap, 'match', c.match, 'value', c.value, 'start', c.start, {fields}))"))
    kind = "case when startswith(c.value, '-----BEGIN') then 'private_key' when c.issued = 1 then 'issued_key' when c.words_for = 1 and c.assigned = 1 then 'assignment' when c.hex = 1 then 'hex_token' else 'token' end"
    rows = rows.withColumn("__found", F.expr(f"transform(__f, c -> named_struct('gap', c.gap, 'match', c.match, 'value', c.value, 'start', c.start, 'kind', {kind}, 'score', {forest}))"))
    return rows.drop("__m", "__g", "__gap", "__next", "__s", "__p", "__z", "__v", "__c", "__f")


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, ordinal, start, end, kind, score, is_secret, value_sha256.

    Offsets count code points from 0, ends are exclusive.  Null and empty texts have no
    candidates; repeated rows give their candidates again; a null path counts as empty.  An empty table gives no rows.
    ``findings`` (value, before, after, path, label) trains the forest.
    """
    forest = train_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), (F.col(f"`{path_col}`") if path_col else F.lit("")).alias("path"))
    # the outer form, as for the inner one Catalyst adds a filter in which all of this would run once more
    rows = scored_candidates(named, forest, "text", "path").select("doc_id", F.posexplode_outer("__found").alias("ordinal", "f")).where("ordinal is not null")
    return rows.select(
        "doc_id",
        "ordinal",
        F.col("f.start").cast("long").alias("start"),
        (F.col("f.start") + F.length("f.value")).cast("long").alias("end"),
        F.col("f.kind").alias("kind"),
        F.col("f.score").alias("score"),
        (F.col("f.score") > THRESHOLD).alias("is_secret"),
        F.sha2(F.col("f.value").cast("binary"), 256).alias("value_sha256"),
    )


def redact_secrets(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text", path_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """``docs`` with each confirmed secret in the text replaced; texts without one (and nulls) are unchanged.

    Each repeated row is treated by itself, so equal rows stay equal; an empty table gives no rows.

    ``length_col``, if given, gets the new length of the texts that changed.
    """
    forest = train_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = scored_candidates(docs, forest, text_col, path_col).withColumn("__any", F.expr(f"exists(__found, c -> c.score > {THRESHOLD})"))
    pieces = f"transform(__found, c -> concat(c.gap, case when c.score > {THRESHOLD} then concat(substring(c.match, 1, length(c.match) - length(c.value)), '{PLACEHOLDER}') else c.match end))"
    rows = rows.withColumn(text_col, F.expr(f"case when __any then concat(array_join({pieces}, ''), __rest) else `{text_col}` end"))
    if length_col:
        kind = docs.schema[length_col].dataType
        rows = rows.withColumn(length_col, F.when(F.col("__any"), F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return rows.select(*docs.columns)
