"""Operator 8: secrets in texts; a random forest over findings removes false positives. DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloom.llm.shared import keyed_rows, small_side, written

KEYS = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|auth|credential)s?"
ASSIGN = r"""(?:["']?[ \t]{0,3}(?:=>|:=|=|:)[ \t]{0,3}|[ \t]{1,3}(?:is|was)[ \t]{1,3})"""
SIGN = rf"""{ASSIGN}["']?"""
# A private key from its BEGIN line to its END line; without an END line, BEGIN and the header lines and lines of key material behind it.
PRIVATE_KEY = r"""-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-[^-]++)*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[rn])*+(?:(?:Proc-Type|DEK-Info|Version|Comment|Charset): [^\n\\]*+|[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9+/]{2,15}={1,2}))*+)"""
# Fixed prefixes of issued keys.
ISSUED = r"(?:A[KS]IA|gh[pousr]_|github_pat_|xox[abprs]-|sk[-_]|AIza|eyJ|glpat-|npm_)"
LOGIN = r"""[^\s/:@"'<>]*+:"""
# A named value. In quotes it runs to its own closing quote, blanks and signs included (a text of over 256 characters with blanks, or
# one that holds a longer key or a URL, is not one value). A passphrase of three words or more runs to the end of its line. A
# password keeps commas and semicolons that neither end it nor begin another setting. Anything else ends at these.
OTHERS = rf"(?:{ISSUED}[A-Za-z0-9_]{{12}}|-----BEGIN|://|[A-Za-z0-9+/_-]{{32}})"
QUOTED = "|".join(rf"{q}(?:[^{q}\s]{{4,}}|(?![^{q}\n]{{0,256}}{OTHERS})[^{q}\n]{{4,256}})(?={q})" for q in "\"'")
PHRASE = r"(?i:pass[-_ ]?phrase)[ \t]{0,3}[:=][ \t]{0,3}[a-z]{2,20}(?:[ -][a-z]{2,20}){2,11}(?=[ \t]*(?:\n|$))"
PASSWORD = r"(?i:pass(?:word|wd|phrase)?|pwd)s?"
NAMED = rf"""{PHRASE}|{KEYS}{ASSIGN}(?:{QUOTED})|{PASSWORD}{SIGN}(?:[^\s"'<>,;]|[,;](?![\s,;]|$|[\w ]{{1,40}}[=:])){{6,}}|{KEYS}{SIGN}[^\s"'<>,;]{{6,}}"""
# A private key, named or not; a named value; the password of a URL; an issued key; or a key-like run with a digit or
# of 32 characters. Each runs to its end.
CANDIDATE = rf"""(?:{KEYS}{SIGN})?{PRIVATE_KEY}|{NAMED}|(?<=://){LOGIN}[^\s/@"'<>]{{3,}}(?=@)|(?<![A-Za-z0-9+/_-])(?:{ISSUED}[A-Za-z0-9_.+/=-]{{12,}}|(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{16,}}|[A-Za-z0-9+/_-]{{32,}})={{0,2}})"""
VENDOR = rf"^(?:A[KS]IA[0-9A-Z]{{16}}$|gh[pousr]_[A-Za-z0-9]{{20,}}|github_pat_|xox[abprs]-|sk[-_][A-Za-z0-9]|AIza[0-9A-Za-z_-]{{30,}}|eyJ[A-Za-z0-9_-]{{10,}}|glpat-|npm_[A-Za-z0-9]{{20,}}|-----BEGIN )"
# Words of code and prose that random strings do not hold; the frequent words of a corpus come on top.
DICTIONARY = tuple("password secret token example sample test dummy change here your user admin name value string number text file path main class service controller handler manager factory config default general public private static string update create delete insert select index table column report version release build package module library common server client request response message data image page content title header footer section chapter paragraph".split())
SECRET_WORDS = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth\w*|bearer|credentials?)\W*$"
BENIGN_WORDS = r"(?i)(?:commit|sha(?:1|256|512)?|hash|checksum|digest|md5|uuid|guid|etag|revision|integrity|version|build|isbn|base64,?|ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-nistp[0-9]+|id|ref|tag|file|path|url|see)\W*$"
PLACEHOLDER = r"(?i)your|example|sample|dummy|change.?me|placeholder|xxxx|\*\*\*\*|<|\$\{|\{\{|1234567|todo|redacted|foobar"
TEST_PATH = r"(?i)(?:^|[/_.-])(?:tests?|specs?|fixtures?|examples?|samples?|docs?|mocks?)(?:[/_.-]|$)|\.lock$"
FEATURES = ["length", "digits", "upper", "lower", "symbols", "transitions", "likeness", "distinct", "hex", "digest_length", "dictionary", "vowels", "slashes", "vendor", "named", "secret_word", "benign_word", "placeholder", "test_path", "blanks", "passphrase"]


def _share(s: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(s, f"[^{chars}]", "")) / F.greatest(F.length(s), F.lit(1))


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = 4096) -> list[str]:
    """The ``most`` (bounded: they go to the driver) words of a to z that occur most often over all whole texts.

    Ties go by the word. Counting is one aggregation with map-side sums; null and empty texts and tables have none.
    """
    raw = docs.where(F.col(text_col).isNotNull()).select(F.explode(F.split(F.lower(F.col(text_col)), " ")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    words = raw.select(F.explode(F.regexp_extract_all("raw", F.lit("[a-z]{2,}"), F.lit(0))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in words.where("n > 1 and length(word) < 40").orderBy(F.desc("n"), "word").limit(most).collect()]


@functools.cache
def transition_scores(words: tuple[str, ...]) -> str:
    """How much likelier than by chance each character follows each other in ``words``, as bits; 28 by 28, comma-separated.

    The characters are a to z, any digit and anything else, which also stands at both ends of a word.
    """
    n = [[0.1] * 28 for _ in range(28)]
    for w in words:
        at = [27, *(ord(c) - 97 if "a" <= c <= "z" else 26 if c.isdigit() else 27 for c in w.lower()), 27]
        for a, b in zip(at, at[1:]):
            n[a][b] += 1
    return ",".join(f"{math.log2(28 * x / sum(row)):.3f}" for row in n for x in row)


def features(secret: Column, before: Column, path: Column, words: tuple[str, ...] = DICTIONARY) -> dict[str, Column]:
    """Each number the forest judges a finding by. ``words`` are the dictionary, of which the usual transitions between
    characters are learnt, too."""
    size = F.greatest(F.length(secret), F.lit(1))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(secret, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "_")
    known = F.filter(F.transform(F.regexp_extract_all(secret, F.lit("[A-Za-z][a-z]+|[A-Z]{2,}"), F.lit(0)), F.lower), lambda w: w.isin(*words))
    folded = F.split(F.regexp_replace(F.regexp_replace(F.lower(secret), "[0-9]", "{"), "[^a-z{]", "|"), "")
    scores = F.expr(f"cast(split('{transition_scores(words)}', ',') as array<double>)")
    steps = F.zip_with(F.slice(folded, 1, size - 1), F.slice(folded, 2, size - 1), lambda a, b: F.get(scores, (F.ascii(a) - 97) * 28 + F.ascii(b) - 97))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": F.length(secret).cast("double"),
        "digits": _share(secret, "0-9"),
        "upper": _share(secret, "A-Z"),
        "lower": _share(secret, "a-z"),
        "symbols": _share(secret, r"\W_"),
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / size,
        "likeness": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / size,
        "distinct": F.size(F.array_distinct(F.split(secret, ""))) / F.least(size, F.lit(64)),
        "hex": flag(secret.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "digest_length": flag(F.length(secret).isin(32, 40, 56, 64, 96, 128) & secret.rlike("^[0-9a-fA-F]+$")),
        "dictionary": F.aggregate(known, F.lit(0), lambda a, w: a + F.length(w)) / size,
        "vowels": _share(F.lower(secret), "aeiou"),
        "slashes": _share(secret, "/.-"),
        "vendor": flag(secret.rlike(VENDOR)),
        "named": flag(before.rlike(rf"""(?:{KEYS}{SIGN}|://[^\s/:@"'<>]*:)$""")),
        "secret_word": flag(before.rlike(SECRET_WORDS)),
        "benign_word": flag(before.rlike(BENIGN_WORDS)),
        "placeholder": flag(secret.rlike(PLACEHOLDER)),
        "test_path": flag(path.rlike(TEST_PATH)),
        "blanks": _share(secret, " "),
        "passphrase": flag(before.rlike(r"(?i)pass[-_ ]?phrase[ \t]{0,3}[:=]\W*$")),
    }


def labelled_findings(spark: SparkSession, each: int = 200, words: tuple[str, ...] = DICTIONARY) -> DataFrame:
    """(before, secret, path, label, kind): ``each`` findings of every kind below, made from hashes of their numbers and
    from the first ``words``."""
    h = lambda salt: f"sha2(concat('{salt}', n), 256)"
    b = lambda salt: f"regexp_replace(base64(unhex(concat({h(salt)}, {h(salt + 'x')}))), '[^A-Za-z0-9]', '')"
    pick = lambda *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), cast(1 + n % {len(xs)} as int))"
    quote = pick("", '"', "")
    some_words = [w for w in words if len(w) > 3][:200] or list(DICTIONARY)
    word = lambda step: f"element_at(array({', '.join(map(repr, some_words))}), cast(1 + (n * {step} + n DIV 7) % {len(some_words)} as int))"
    key_lines = f"repeat(concat('\\n', substring({b('q')}, 1, 64)), cast(2 + n % 40 as int))"
    kinds = [
        (f"concat({pick('token', 'auth_token', 'secret', 'api_key', 'access_token')}, {pick(' = ', '=', ': ')}, {quote})", f"substring({h('a')}, 1, cast({pick(40, 32, 24)} as int))", 1),
        (f"concat({pick('password', 'db_password', 'passwd', 'pwd')}, {pick('=', ' = ', ': ')}, {quote})", f"substring({h('b')}, 1, cast({pick(18, 12, 16, 20)} as int))", 1),
        (f"concat({pick('password', 'pass', 'pwd')}, {pick('=', ' = ', ': ')}, {quote})", f"concat({pick('Sun', 'Tiger', 'Blue', 'Kx')}, substring({b('c')}, 1, 6), {pick('!', '#9', '42')})", 1),
        (pick("of ", "with ", "the ", "see ", "", "tag ", "ref: "), f"concat('AKIA', substring(upper({b('d')}), 1, 16))", 1),
        (f"concat({pick('api_key', 'apikey', 'client_key', 'secret')}, {pick('=', ': ', ' = ')}, {quote})", f"substring({b('e')}, 1, 36)", 1),
        (pick("bearer ", "Authorization: Bearer ", "and "), f"concat('eyJ', substring({b('f')}, 1, 30))", 1),
        (pick("use ", "token ", "", "url ", "see "), f"concat('ghp_', substring({b('g')}, 1, 36))", 1),
        (pick("slack ", "", "the ", "version "), f"concat({pick('xoxb-', 'sk-', 'AIza')}, substring({b('i')}, 1, 38))", 1),
        (pick("aws_secret_access_key = ", "secret: ", "private_key="), f"substring({b('j')}, 1, 40)", 1),
        (pick("commit ", "commit: ", "revision ", "sha "), f"substring({h('k')}, 1, 40)", 0),
        (pick("sha256:", "checksum ", "digest: ", "md5 ", "hash="), f"substring({h('l')}, 1, cast({pick(64, 32, 40)} as int))", 0),
        (pick("id=", "uuid ", "guid: ", "the "), f"regexp_replace(substring({h('m')}, 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '$1-$2-$3-$4-')", 0),
        (f"concat({pick('password', 'token', 'api_key', 'secret')}, {pick('=', ': ', ' = ')}, {quote})", f"concat({pick('your_password_here', 'changeme', 'xxxxxxxxxxxxxxxx', 'example_token_value', '${SECRET_TOKEN}', '<your-token>', 'password123', 'dummy-secret-value')}, {pick('', '1', '_2')})", 0),
        (f"concat({pick('token', 'secret', 'auth', 'password')}, {pick(' = ', ': ', '=')})", f"concat({pick('request', 'user', 'config', 'self', 'response', 'client')}, {pick('.get_value', '.password', 'Service.create', '_manager.token', '.headers[0]')}, {pick('()', '', '(name)')})", 0),
        (pick("see ", "file ", "in ", "from "), f"concat({pick('src/main/service', 'lib/common/module', 'docs/chapter', 'app/static/image')}, n % 90, {pick('/index/handler', '/test/report', '/content-page')})", 0),
        (pick("call ", "the ", "class ", "a "), f"concat({pick('getUserById', 'updateTable', 'requestHandler', 'utf8_general_ci_')}, n % 50, {pick('ControllerFactory', '_config_value', 'ServiceManager')})", 0),
        (pick("on ", "at ", "from "), f"concat('2024-0', 1 + n % 9, '-1', n % 10, '-', lpad(n % 60, 2, '0'), '-', lpad(n % 59, 2, '0'), '-00')", 0),
        (pick("base64,", "image ", "data:image/png;base64,"), f"repeat({b('o')}, 4)", 0),
        (pick("isbn ", "phone ", "call ", "no. "), f"concat('978-3-16-', lpad(n * 7919 % 999999, 6, '0'), '-', n % 10)", 0),
        (pick("the ", "a ", "of ", ""), f"concat({word(1)}, {pick('-', '_', '/', '')}, {word(3)}, {pick('-', '_', '/', '')}, {word(7)}, {pick('-', '_', '/', '')}, {word(11)}, n % 100)", 0),
        (f"concat({pick('password', 'token', 'secret', 'credentials')}, {pick(' is ', ' was ', ': ', ' = ')})", f"concat({word(5)}, {pick('', '.', '_', '-')}, {pick('', word(2), word(9))})", 0),
        (f"concat({pick('password', 'token', 'secret', 'passphrase')}, {pick(' is ', ' was ')})", f"concat(substring({b('u')}, 1, cast({pick(10, 16, 24)} as int)), {pick('!', '', '#7')})", 1),
        (f"concat({pick('postgres', 'https', 'mysql', 'amqp')}, '://', {pick('app', 'root', 'svc_user', 'admin')}, ':')", f"substring({b('v')}, 1, cast({pick(8, 12, 16, 24)} as int))", 1),
        (f"concat({pick('postgres', 'https', 'mysql', 'amqp')}, '://', {pick('app', 'root', 'user', 'admin')}, ':')", f"concat({pick('${DB_PASSWORD}', 'password', 'changeme', 'yourpassword')}, {pick('', '1')})", 0),
        (pick("use ", "the ", ""), f"concat('ghp_', regexp_replace(substring({b('w')}, 1, 36), '[0-9]', 'q'))", 1),
        (pick("glpat ", "with ", ""), f"concat({pick('glpat-', 'npm_', 'github_pat_')}, substring({b('y')}, 1, 36))", 1),
        (pick("token: ", "password: ", "secret: "), f"substring({h('p')}, 1, 32)", 0, "tests/fixtures/example.txt"),
        (pick("", "key: ", "private_key = ", "the "), f"concat('-----BEGIN ', {pick('RSA ', 'EC ', 'OPENSSH ', '')}, 'PRIVATE KEY-----', {key_lines}, '\\n-----END ', {pick('RSA ', 'EC ', 'OPENSSH ', '')}, 'PRIVATE KEY-----')", 1),
        (pick("", "key: ", "private_key = "), f"concat('-----BEGIN ', {pick('RSA ', 'EC ', '')}, 'PRIVATE KEY-----', {key_lines})", 1),
        (f"concat({pick('token', 'api_key', 'secret', 'access_token')}, {pick('=', ': ', ' = ')})", f"repeat({b('s')}, cast(2 + n % 200 as int))", 1),
        (pick("base64,", "image ", "data:image/png;base64,"), f"repeat({b('t')}, cast(20 + n % 200 as int))", 0),
        (f"concat({pick('password', 'passwd', 'secret', 'pwd')}, {pick('=', ' = ', ': ')}, {pick(chr(34), '`')})", f"concat({pick('Red', 'our', 'K7', '')}, substring({b('z')}, 1, 5), {pick(' ', ', ', ' & ', ';')}, substring({b('aa')}, 1, cast({pick(5, 8, 11)} as int)), {pick('', '!', '?')})", 1),
        (f"concat({pick('DB_PASS', 'PASSWORD', 'pwd', 'MYSQL_PASS')}, {pick('=', ': ')})", f"concat(substring({b('ab')}, 1, 4), {pick(',', ';', '$')}, substring({b('ac')}, 1, cast({pick(3, 5, 9)} as int)), {pick(';', ',', '%')}, substring({b('ad')}, 1, 5))", 1),
        (f"concat({pick('passphrase', 'pass_phrase', 'key passphrase')}, {pick(': ', ' = ', '=')})", f"concat({word(1)}, {pick(' ', '-')}, {word(5)}, ' ', {word(9)}, {pick('', ' ')}, {word(13)})", 1),
        (f"concat({pick('password', 'token', 'secret', 'auth')}, {pick(': ', ' = ')}, {pick(chr(34), '`')})", f"concat({pick('please enter', 'must not be', 'the field for', 'invalid', 'reset your')}, ' ', {word(3)}, ' ', {word(8)}, ' ', {word(15)})", 0),
        (pick("ssh-rsa ", "ssh-ed25519 ", "ecdsa-sha2-nistp256 "), f"concat('AAAA', {pick('B3NzaC1yc2EAAAADAQAB', 'C3NzaC1lZDI1NTE5AAAAI', 'E2VjZHNhLXNoYTItbmlzd')}, repeat({b('ae')}, cast(1 + n % 5 as int)))", 0),
    ]
    made = None
    for k, (before, secret, label, *path) in enumerate(kinds):
        some = spark.range(k * each, (k + 1) * each, 1, 1).withColumnRenamed("id", "n").selectExpr(f"{before} as before", f"{secret} as secret", f"'{path[0] if path else 'src'}' as path", f"cast({label} as double) as label", f"{k} as kind")
        made = some if made is None else made.unionByName(some)
    return made


class SecretModel:
    """A fitted forest and the dictionary its features look words up in."""

    def __init__(self, stages: PipelineModel, words: tuple[str, ...]):
        self.stages, self.words = stages, words

    def judged(self, findings: DataFrame, secret: str = "secret", before: str = "before", path: str = "path") -> DataFrame:
        """``findings`` with probability: how likely each is a secret."""
        rows = findings.select("*", *(c.alias(n) for n, c in features(F.col(secret), F.col(before), F.col(path), self.words).items()))
        return self.stages.transform(rows).select(*findings.columns, vector_to_array("probability")[1].alias("probability"))


def fit_forest(findings: DataFrame, trees: int = 30, depth: int = 8, words: tuple[str, ...] = DICTIONARY) -> SecretModel:
    """A random forest over ``findings`` (before, secret, path, label), which have to be a bounded table."""
    rows = findings.select(*(c.alias(n) for n, c in features(F.col("secret"), F.col("before"), F.col("path"), words).items()), "label")
    rows = written(rows.coalesce(1), "findings")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    model: RandomForestClassificationModel = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.8, featureSubsetStrategy="sqrt").fit(assemble.transform(rows))
    return SecretModel(PipelineModel([assemble, model]), words)


def corpus_forest(docs: DataFrame, text_col: str = "text") -> SecretModel:
    """The forest in production: its dictionary holds the frequent words of all texts of ``docs``, too."""
    words = tuple(dict.fromkeys([*DICTIONARY, *corpus_words(docs, text_col)]))
    return fit_forest(labelled_findings(docs.sparkSession, words=words[len(DICTIONARY) :] or DICTIONARY), words=words)


def scan_secrets(docs: DataFrame, forest: SecretModel, keep: list[str], text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """A row for each secret: ``keep`` of its row, nth, start (from 0, in characters), n_chars, secret, probability.

    Candidates are private keys from BEGIN to END, named values, passwords of URLs, issued keys and key-like runs, each
    whole; findings the forest gives less than ``threshold`` are false positives and go. Texts are read whole, in one
    pass: a filter for rows with any candidate, then marks around each, at which the text is split. Only candidates
    are shuffled, to add up their offsets. Null and empty texts have none; rows that repeat give their own findings
    each; a null path is no test path; empty tables give no rows.
    """
    text = F.col("__text")
    mark = F.concat(F.lit("\ue000"), F.hex(F.xxhash64(text)), F.lit("\ue000"))
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.where(F.col(text_col).rlike(CANDIDATE)).select(F.struct(*keep).alias("__who"), path.alias("__path"), F.col(text_col).alias("__text"))
    parts = rows.select("__who", "__path", F.monotonically_increasing_id().alias("__row"), F.split(F.regexp_replace(text, F.lit(CANDIDATE), F.concat(mark, F.lit("$0"), mark)), mark).alias("__parts"))
    each = F.transform(
        F.sequence(F.lit(1), F.size("__parts") - 1, F.lit(2)),
        lambda i: F.struct(((i - 1) / 2).cast("int").alias("nth"), F.length(F.get("__parts", i - 1)).alias("gap"), F.substring(F.get("__parts", i - 1), -80, 80).alias("left"), F.get("__parts", i).alias("found")),
    )
    found = parts.select("__who", "__path", "__row", F.explode(each).alias("c")).select("__who", "__path", "__row", "c.*")
    so_far = Window.partitionBy("__row").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("at", F.sum(F.col("gap") + F.length("found")).over(so_far) - F.length("found"))
    key = F.regexp_extract("found", f"^({KEYS}{SIGN})", 1)
    key = F.when(key != "", key).when(F.col("left").endswith("://"), F.regexp_extract("found", f"^({LOGIN})", 1)).otherwise("")
    found = found.withColumn("key", key).withColumn("secret", F.expr("substring(found, length(key) + 1)")).withColumn("before", F.concat("left", "key"))
    judged = forest.judged(found, "secret", "before", "__path").where(F.col("probability") >= threshold)
    return judged.select(*(F.col(f"__who.{c}").alias(c) for c in keep), "nth", (F.col("at") + F.length("key")).cast("int").alias("start"), F.length("secret").alias("n_chars"), "secret", "probability")


def redact_secrets(docs: DataFrame, forest: SecretModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, label: str = "[SECRET]", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``label``; all rows and columns stay.

    Rows without a finding keep their text to the byte. Findings go to the documents by broadcast if their files are
    small, else by a join. Nulls, repeats and empty tables are as in ``scan_secrets``.
    """
    rows = keyed_rows(docs, id_col, *(c for c in docs.columns if c != id_col), key="__key")
    spans = scan_secrets(rows, forest, ["__key"], text_col, path_col, threshold).select("__key", F.struct(F.col("start"), F.col("n_chars")).alias("span"))
    spans = written(spans.groupBy("__key").agg(F.array_sort(F.collect_set("span")).alias("__spans")), "secrets")
    spans = small_side(spans, broadcast_bytes)
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("__spans", i - 1)["start"] + F.get("__spans", i - 1)["n_chars"])
    stop = lambda i: F.coalesce(F.get("__spans", i)["start"], F.length(text_col))
    pieces = F.transform(F.sequence(F.lit(0), F.size("__spans")), lambda i: F.substr(F.col(text_col), start(i) + 1, stop(i) - start(i)))
    cleaned = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.array_join(pieces, label))
    return rows.join(spans, "__key", "left").withColumn(text_col, cleaned).select(*docs.columns)
