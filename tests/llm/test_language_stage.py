"""The pipeline's language stage rejects what no learned codeword is near."""

import hashlib

from conftest import DATA

import corpus_pipeline

FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek ésszel és lelkiismerettel bírnak.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri.",
    "\u0412\u0441\u0435 \u043b\u044e\u0434\u0438 \u0440\u043e\u0436\u0434\u0430\u044e\u0442\u0441\u044f \u0441\u0432\u043e\u0431\u043e\u0434\u043d\u044b\u043c\u0438 \u0438 \u0440\u0430\u0432\u043d\u044b\u043c\u0438.",
    hashlib.sha512(b"a").hexdigest() * 3,
    "qzx wvk jjq " * 30,
    "a" * 300,
    "for(i=0;i<n;i++){x[i]=f(y[i],&z)->p;}\n" * 10,
]


def test_unlearned_languages_go(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9000 + i, t, None, "src0", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(extra), "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
