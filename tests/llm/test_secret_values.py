"""Values with blanks, commas and semicolons, key headers, public keys, and recall and precision kind by kind."""

import base64
import random
import string

import pytest
from conftest import DATA

from sparkloom.llm import secret_scan

RNG = random.Random(29)
ALNUM = string.ascii_letters + string.digits
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY_LINE = base64.b64encode(RNG.randbytes(48)).decode()


def some(n, chars=ALNUM):
    return "".join(RNG.choice(chars) for _ in range(n))


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.corpus_forest(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)


CASES = [
    ("password='My Str0ng P4ss!' end", "password='[SECRET]' end"),
    ('password = "abc,def;Gh12kLm!z9" end', 'password = "[SECRET]" end'),
    ("DB_PASS=Hq7,zW3;pL9xTn\nnext", "DB_PASS=[SECRET]\nnext"),
    ("passphrase: correct horse battery staple\nnext line", "passphrase: [SECRET]\nnext line"),
    (f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n{KEY_LINE}\n{KEY_LINE}\n\nplain words", "[SECRET]\n\nplain words"),
    ("Password=Zk8rT2qLw9Xb;Server=db.host", "Password=[SECRET];Server=db.host"),
    ("password=Zk8rT2qLw9Xb, and more", "password=[SECRET], and more"),
    (f'token: "see AKIA{"Q7ZT" * 4} in the vault"', 'token: "see [SECRET] in the vault"'),
]


def test_values_run_to_their_ends(spark, forest):
    got = [r.text for r in secret_scan.redact_secrets(frame(spark, [t for t, _ in CASES]), forest).orderBy("doc_id").collect()]
    assert got == [want for _, want in CASES]


CLEAN = [
    "ssh-rsa AAAAB3NzaC1yc2EAAAADAQABAAABgQ" + some(330) + " me@host",
    'password = "please enter the password again"',
    "passphrase: the words you chose when the account was made are asked for here. Then go on.",
    "the secret is out and the token is invalid",
    "fixed in commit " + some(40, "0123456789abcdef"),
]


def test_clean_texts_stay(spark, forest):
    assert [r.text for r in secret_scan.redact_secrets(frame(spark, CLEAN), forest).orderBy("doc_id").collect()] == CLEAN


def planted():
    """Ten kinds of secrets in sentences, in forms that the forest's templates do not have; and look-alikes."""
    hexa = "0123456789abcdef"
    make = {
        "quoted token": lambda: ('auth_token: "{}"', some(RNG.choice([28, 44]), hexa)),
        "aws id": lambda: ("export AWS_KEY_ID {} for it", "AKIA" + some(16, string.ascii_uppercase + string.digits)),
        "github": lambda: ("cloned using {} there", "ghs_" + some(36)),
        "jwt": lambda: ("curl -H 'X-Auth {}'", "eyJhbGciOiJI" + some(20) + "." + "eyJz" + some(40) + "." + some(43)),
        "url password": lambda: ("redis://cache:{}@10.0.0.3:6379/0", some(18)),
        "env password": lambda: ("MYSQL_PASSWORD={}\n", some(5) + RNG.choice("#%+") + some(6)),
        "spaced password": lambda: ("passwd: '{}'", some(6) + " " + some(7) + "!"),
        "comma password": lambda: ("ADMIN_PWD={} ", some(4) + "," + some(6) + ";" + some(3)),
        "slack": lambda: ("bot uses {} now", "xoxp-" + some(11, string.digits) + "-" + some(24)),
        "private key": lambda: ("{}", "-----BEGIN EC PRIVATE KEY-----\n" + some(64) + "\n" + some(40) + "\n-----END EC PRIVATE KEY-----"),
    }
    return {kind: [f() for _ in range(25)] for kind, f in make.items()}


def test_recall_of_each_kind_and_precision(spark, forest):
    hexa = "0123456789abcdef"
    texts = [(kind, before.format(secret), secret) for kind, rows in planted().items() for before, secret in rows]
    for _ in range(25):
        texts += [("clean", f"merged as revision {some(40, hexa)} today", None), ("clean", f"md5 {some(32, hexa)}  file.tar", None), ("clean", f"see lib/common/{some(6, string.ascii_lowercase)}/handler_{RNG.randrange(99)}/index_main", None)]
    rows = frame(spark, [f"Some words before. {t} And words behind." for _, t, _ in texts])
    found = {}
    for r in secret_scan.scan_secrets(rows, forest, ["doc_id"]).collect():
        found.setdefault(r.doc_id, []).append(r.secret)
    recall = {}
    for i, (kind, _, secret) in enumerate(texts):
        recall.setdefault(kind, []).append(secret in found.get(i, []) if secret else i not in found)
    low = {k: sum(v) / len(v) for k, v in recall.items() if sum(v) < 0.9 * len(v)}
    assert not low
    right = sum(s == texts[i][2] for i, ss in found.items() for s in ss)
    assert right >= 0.9 * sum(map(len, found.values()))
