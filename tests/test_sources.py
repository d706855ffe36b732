"""Files through the readers and normalisers: numbering, quarantine, lineage."""

import json

from assure.sources import normalise, readers


def test_bank_file(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text('bank_ref,credit,debit,value_date,narration\nb1,"1,115.15",,2026-07-01,UTR:ABCDEFGHIJKLMNO PLATFORM SETTLEMENT\nb2,oops,,2026-07-01,x\nb3,5.00,,2026-99-01,x\nb4,7.00,,2026-07-02,no number\n')
    rows = normalise.normalised(readers.csv_rows(spark, str(path), "bank"), normalise.bank_fields(), "bank")
    got = {r["raw_id"]: (r["amount_paise"], str(r["credited_on"]), r["utr"], r["quarantine_detail"]) for r in rows.collect()}
    assert got["raw_bank_00001"] == (111515, "2026-07-01", "ABCDEFGHIJKLMNO", None)
    assert got["raw_bank_00002"][3] == "malformed bank row: credit" and got["raw_bank_00003"][3] == "malformed bank row: value_date"
    assert got["raw_bank_00004"] == (700, "2026-07-02", None, None)  # no reference is no fault
    assert tuple(normalise.counts(rows, "bank").head()) == ("bank", 4, 2, 2)
    steps = [(r["raw_id"], r["field"]) for r in normalise.lineage(rows.drop("amount_paise", "credited_on", "utr"), normalise.bank_fields(), "raw_id").collect()]
    assert ("raw_bank_00003", "amount_paise") in steps and ("raw_bank_00003", "credited_on") not in steps


def test_processor_document(spark, tmp_path):
    pay = {"id": "p1", "order_id": "o1", "amount": 100, "currency": "INR", "method": "card", "status": "captured", "captured_at": 0, "fee": 2, "tax": 1}
    path = tmp_path / "razorpay.json"
    path.write_text(json.dumps({"payments": [pay, pay | {"id": "p2", "amount": 5.5}, pay | {"id": "p3", "method": "barter"}], "transfers": [], "refunds": [{"id": "r1", "payment_id": "p1", "amount": 3, "created_at": 60}], "reversals": [], "disputes": [], "settlements": []}))
    rows = readers.processor_rows(spark, str(path))
    assert [(r["line_no"], r["kind"]) for r in rows.orderBy("line_no").collect()] == [(1, "payments"), (2, "payments"), (3, "payments"), (4, "refunds")]
    done = normalise.normalised(rows.where("kind = 'payments'"), normalise.payment_fields(), "payment")
    assert {r["raw_id"]: r["quarantine_detail"] for r in done.collect()} == {
        "raw_razorpay_00001": None, "raw_razorpay_00002": "malformed payment row: $.amount", "raw_razorpay_00003": "malformed payment row: $.method",
    }
    refund = normalise.normalised(rows.where("kind = 'refunds'"), normalise.refund_fields(), "refund").head()
    assert refund["amount_paise"] == 3 and str(refund["created_at_utc"]) == "1970-01-01 00:01:00"


def test_numbering_without_one_task(spark):
    rows = readers.numbered(spark.range(1000, 0, -1).withColumnRenamed("id", "n"), "n")
    assert {(r["n"], r["line_no"]) for r in rows.collect()} == {(i, i) for i in range(1, 1001)}


def test_provenance(spark, tmp_path):
    import hashlib

    path = tmp_path / "a.csv"
    path.write_text("x\n")
    r = readers.provenance(spark, [str(path)]).head()
    assert (r["sha256"], r["bytes"], r["extension"]) == (hashlib.sha256(b"x\n").hexdigest(), 2, "csv")


def test_files_are_digested_in_order_and_never_as_one_value(spark, tmp_path):
    import hashlib

    texts = {
        "a.csv": b"x", "c.csv": b"a\r\nb\n\n\nc\r\n", "d.csv": b"\xef\xbb\xbfa,b\n1,2", "e.csv": b"\xff\xfe\x00bad\n\xc3" * 5, "f.csv": b"\n", "g.csv": b"".join(b"%d,abc\n" % i for i in range(50_000)),
        "h.json": b'{"a": [{"x": 1}, {"y": "}"}]}\n', "i.json": b'{"a": 1}', "j.json": b"\xef\xbb\xbf" + b'{"a": 1},' * 20_000,
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    most = "spark.sql.sources.binaryFile.maxLength"  # by default what one value may hold: no file is read as such
    before = spark.conf.get(most)
    spark.conf.set(most, 10)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.provenance(spark, [f"file://{tmp_path}/{name}" for name in texts]).collect()
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "8k"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set(most, before)
    assert {r["path"].split("/")[-1]: (r["sha256"], r["bytes"]) for r in rows} == {name: (hashlib.sha256(text).hexdigest(), len(text)) for name, text in texts.items()}


def test_sellers_of_one_name(spark):
    sellers = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "B")], "seller_id string, seller_name string")
    rows = spark.createDataFrame([("A",), ("B",), ("C",)], "seller_name string")
    got = {r["seller_name"]: (r["seller_id"], r["resolution"]) for r in normalise.resolved_sellers(rows, sellers).collect()}
    assert got == {"A": ("A", "seller_name_ambiguous"), "B": ("s3", "seller_name_resolved"), "C": ("C", "seller_name_not_found")}


def plain_csv(path):
    import csv

    with open(path, newline="") as f:
        return [tuple(r) for r in csv.reader(f) if r][1:]


def test_csv_in_splits(spark, tmp_path):
    import random

    rng = random.Random(2)
    for case, cells in enumerate((["a", "1,50.5", "", "x y"], ["a", 'say "hi"', "two\nlines", "", "end\n\n", ","])):
        path = tmp_path / f"bank{case}.csv"
        import csv

        with open(path, "w", newline="") as f:
            out = csv.writer(f, lineterminator="\r\n" if case == 0 else "\n")
            out.writerow(readers.COLUMNS["bank"])
            for i in range(3000):
                out.writerow([f"b{i}", *(rng.choice(cells) for _ in range(4))])
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        try:
            rows = readers.csv_rows(spark, str(path), "bank")
            got = [tuple(x or "" for x in r) for r in rows.orderBy("line_no").select(*readers.COLUMNS["bank"]).collect()]
            assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
            numbers = [r["line_no"] for r in rows.select("line_no").orderBy("line_no").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == plain_csv(path) and numbers == list(range(1, 3001))


def test_processor_document_in_splits(spark, tmp_path):
    def doc(strange=""):
        pay = [{"id": f"p{i}", "order_id": "o [1]", "amount": i, "note": f'q " {strange}' if i == 7 else None} for i in range(2000)]
        trf = [{"id": f"t{i}", "payment_id": f"p{i}", "amount": i} for i in range(1500)]
        return {"transfers": trf, "refunds": [], "payments": pay, "other": [{"id": "z"}], "reversals": [], "disputes": [{"id": "d1"}], "settlements": []}

    for case, (strange, indent) in enumerate((("", None), ("", 2), ("} {", None))):
        path = tmp_path / f"doc{case}.json"
        path.write_text(json.dumps(doc(strange), indent=indent))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        try:
            rows = [(r["line_no"], r["kind"], r["id"]) for r in readers.processor_rows(spark, str(path)).selectExpr("line_no", "kind", "variant_get(item, '$.id', 'string') AS id").orderBy("line_no").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        want = [("payments", f"p{i}") for i in range(2000)] + [("transfers", f"t{i}") for i in range(1500)] + [("disputes", "d1")]
        assert rows == [(n, *x) for n, x in enumerate(want, 1)]
