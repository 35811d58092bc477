import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tablemill.llm import pii
from tablemill.llm.queries import QUERIES
from tests.llm.conftest import NASTY

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, shape) in enumerate(SHAPES.items()):
        for m in re.finditer(shape, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark, small):
    return pii.fit(spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet"))


PIECES = ["a", "jo.e", "@", "mail", ".", "com", "-", "_", "%", " ", "  ", "+", "1", "22", "255", "256", "0042", "4111111111111111", "4111 1111-1111 1111", "(", ")", "555", "1.2.3.4", "+1 (310) 555-4510", "é", "漢", "\U0001f600", "\x01", "\x02", "\n", "@x.y", "$1", "\\"]


def test_base_spans_against_plain_search(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(1, 30))) for _ in range(3000)]
    rows = pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), None).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s.start, s.kind, s.end) for s in r.pii] == brute_base(r.text), r.text


def planted():
    """Examples that the templates don't make: (text, kind, value) and texts without anything of the six kinds."""
    rng = random.Random(8)
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    good, clean = [], []
    for _ in range(60):
        ssn = f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
        phone = f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{n(4)}"
        account = n(18)
        iban = f"DE{98 - int(account + '131400') % 97:02d}{account}"
        good += [(f"His SSN was {ssn}, they said.", "ssn", ssn), (f"You can call us: {phone}!", "local_phone", phone), (f"The account {iban} was closed", "iban", iban)]
        mail = f"{rng.choice(['max', 'k.lee'])} [at] {rng.choice(['firm', 'lab'])} [dot] org"
        good += [(f"Please write to {mail} soon", "spelled_email", mail), (f"She was born {rng.randrange(1950, 2000)}-0{rng.randrange(1, 9)}-1{n(1)} in", "birth_date", None)]
        clean += [f"see order {phone} there", f"part {ssn} is out", f"meet at noon dot then", f"released 2021-0{rng.randrange(1, 9)}-11 and", f"invoice DE{n(20)} of", f"serial {n(4)}.{n(4)}.{n(4)}.{n(4)} broke", f"in {n(4)} there were {n(3)} of them"]
    return good, clean


def test_held_out_accuracy(spark, model):
    good, clean = planted()
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([g[0] for g in good] + clean)], "doc_id int, text string")
    found = {r.doc_id: [pii.ALL[s.kind] for s in r.pii] for r in pii.pii_spans(rows, model).collect()}
    hits = sum(kind in found[k] for k, (_, kind, _) in enumerate(good))
    false = sum(bool(set(found[len(good) + k]) - set(pii.BASE)) for k in range(len(clean)))
    assert hits >= 0.95 * len(good) and false <= 0.05 * len(clean), (hits / len(good), false / len(clean))


def test_thresholds_hold_their_precision(spark, model, small):
    seen = pii.examples(spark.read.parquet(f"{small}/documents.parquet"), texts=200).where("held_out")
    for r in seen.select("kind_name", "good", model.score(F.col).alias("score")).groupBy("kind_name").agg(F.collect_list(F.struct("good", "score")).alias("all")).collect():
        taken = [x.good for x in r["all"] if x.score >= model.thresholds[r.kind_name]]
        assert sum(taken) >= 0.9 * len(taken)


def test_query_against_plain_search(spark, small):
    path = small.replace("0.001", "0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    df = QUERIES["op12_pii"](spark, path)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(r.n_email for r in rows) > 5
    for r in rows:
        base = brute_base(texts[r.doc_id])
        said = ",".join(f"{list(SHAPES)[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_long_texts_take_linear_time(spark, model):
    import time

    texts = ["call 555-234-1234 " * 20_000, "x" * 1_000_000, "a@b.cc " * 30_000, "1.2.3.4." * 50_000, "1 " * 300_000, "a@" * 300_000, "+1 " * 100_000]
    began = time.perf_counter()
    rows = pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model, keep=["doc_id"]).select("doc_id", F.size("pii").alias("n")).collect()
    assert {r.doc_id: r.n for r in rows}[2] == 30_000 and {r.doc_id: r.n for r in rows}[0] == 20_000
    assert time.perf_counter() - began < 60


def test_pii_nasty(spark, nasty, model):
    extra = nasty.withColumns({"pii": F.lit(1), "_read": F.lit(2), "_spans": F.lit(3)})
    rows = pii.pii_spans(extra, model).collect()
    assert len(rows) == len(NASTY) and all(r.pii == [] and r._read == 2 for r in rows)
    assert pii.pii_spans(extra.limit(0), model).count() == 0 and pii.fit(nasty.limit(0)) is None
    assert pii.fit(nasty.where("text is null")) is not None
    clear = pii.redacted(extra, model)
    assert clear.columns == extra.columns and [r.text for r in clear.collect()] == [r[1] for r in NASTY]
    said = "é mail a.b@c.de or +1 (310) 555-4510, ssn 123-45-6789."
    df = spark.createDataFrame([(1, said, "x")], "doc_id int, text string, _spans string")
    assert pii.redacted(df, model).collect()[0][:2] == (1, "é mail [EMAIL] or [PHONE], ssn [SSN].")
