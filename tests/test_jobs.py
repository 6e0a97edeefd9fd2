"""Jobs over many units: rows told apart, values carried over, professionals kept, gates, streams, command line."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.cli import main
from veilspark.functions import text as X
from veilspark.functions.spans import SPANS, merge_spans, pattern_spans, splice
from veilspark.operators import ink
from veilspark.operators.detect import detect
from veilspark.operators.fields import fields_of, grounded, model_spec, with_fields
from veilspark.operators.geometry import identity_scores, scores
from veilspark.operators.mask import findings_of, mask, mask_columns
from veilspark.operators.policy import policy
from veilspark.operators.positioned import barcode_spans, labelled_values, localised, merged_regions, needs_ocr, segment_texts, signature_regions, without_money, without_repeats, words_of_lines
from veilspark.operators.verify import left_names, left_patterns, left_values, pattern_flags, seeds_of
from veilspark.streaming.masking import mask_stream

UNITS = "unit long, text string, hint string"
MAIL = policy(entities=("EMAIL_ADDRESS",))


def found(spark, text, hint="", **kw):
    df = spark.createDataFrame([(0, text, hint)], UNITS)
    return [(r["entity"], r["text"]) for r in findings_of(detect(df, policy(**kw))).orderBy("start").collect()]


def test_null_repeated_and_shared_units_are_masked_row_by_row(spark):
    rows = [(None, "mail ab.c@example.net now", None), (None, "or de@example.net", ""), (1, "xy@example.net", ""), (1, "xy@example.net", ""), (1, "other ab.c@example.net", ""), (2, None, ""), (2, "", None)]
    got = sorted(((r["unit"], r["text"], r["masked"], r["n_spans"]) for r in mask(spark.createDataFrame(rows, UNITS), MAIL).collect()), key=repr)
    number = {"xy@example.net": 0, "ab.c@example.net": 1, "de@example.net": 2}

    def brute(t):
        return None if t is None else re.sub(r"\b[\w.+-]{2,}@[\w.-]{2,}\b", lambda m: f"<EMAIL#{number[m[0]]}>", t)

    assert got == sorted(((u, t, brute(t), len(re.findall("@", t or ""))) for u, t, _ in rows), key=repr)


def test_columns_with_null_and_repeated_keys(spark):
    rows = [(None, "a1@example.net", "x"), ("k", "bc@example.net", None), ("k", "cd@example.net bc@example.net", "y"), ("k", "cd@example.net bc@example.net", "y")]
    df = spark.createDataFrame(rows, "k string, `e.mail` string, other string")
    out = mask_columns(df, "k", ["e.mail", "other"], MAIL)
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(None, "a1@example.net", "x"), ("k", "<EMAIL#0>", None), ("k", "<EMAIL#1> <EMAIL#0>", "y"), ("k", "<EMAIL#1> <EMAIL#0>", "y")], key=repr)
    ids = spark.createDataFrame([(1, "CUS-4827")], "k int, customer_id string")
    assert mask_columns(ids, "k", ["customer_id"]).first()["customer_id"] == "CUS-4827"
    assert mask_columns(ids, "k", ["customer_id"], normalize_headers=True).first()["customer_id"] == "<ID#0>"


def test_spans_are_those_of_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, [(a := rng.randint(0, 200), a + rng.randint(1, 15), rng.choice("AB"), rng.choice([0.5, 0.7, 0.9]), "t", "p", rng.randint(0, 4)) for _ in range(rng.randint(0, 30))]) for k in range(200)]

    def brute(spans):
        out = []
        for s in sorted(spans, key=lambda s: (s[0] - s[1], -s[3], s[0], s[6], s)):
            if all(not (t[0] < s[1] and s[0] < t[1]) for t in out):
                out.append(s)
        return sorted(out)

    df = spark.createDataFrame(rows, f"k int, s {SPANS}")
    assert {r["k"]: [tuple(x) for x in r["m"]] for r in df.select("k", merge_spans(F.col("s")).alias("m")).collect()} == {k: brute(s) for k, s in rows}
    texts = [("é😀 ab@cd.ef x " * n) + "tail" for n in (0, 1, 3, 3000)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("sp", pattern_spans(F.col("t"), r"ab@cd\.ef", "E", 0.9, "p", 1))
    d = d.withColumn("o", splice(F.col("t"), F.transform("sp", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("<E#0>").alias("tag")))))
    for r in d.collect():
        assert [(s["start"], s["end"]) for s in r["sp"]] == [m.span() for m in re.finditer(r"ab@cd\.ef", r["t"])] and r["o"] == r["t"].replace("ab@cd.ef", "<E#0>")


@pytest.mark.parametrize(
    ("text", "kw", "expected"),
    [
        ("at 12 Park Lane Drive now", {}, [("LOCATION", "12 Park Lane Drive")]),
        ("Mercy Hospital", {"mask_organizations": True}, []),
        ("Saint Mercy Hospital", {"mask_organizations": True}, [("ORGANIZATION", "Saint Mercy Hospital")]),
        ("Old Mercy Medical Center Group", {"mask_organizations": True}, [("ORGANIZATION", "Old Mercy Medical Center Group")]),
        ("Springfield, IL 62704", {}, [("LOCATION", "Springfield, IL 62704")]),
        ("Age: |46|", {}, [("AGE", "46")]),
        ("Case ID: «CS-48271»", {}, [("GENERIC_ID", "CS-48271")]),
        ("record id 46years", {}, [("AGE", "46years")]),
        ("ITIN 912-70-1234", {"entities": ("US_ITIN",)}, [("US_ITIN", "912-70-1234")]),
        ("DEA AB1234563 or AB1234564", {"entities": ("MEDICAL_LICENSE",)}, [("MEDICAL_LICENSE", "AB1234563")]),
        ("Passport no. 123456789, 987654321", {"entities": ("US_PASSPORT",)}, [("US_PASSPORT", "123456789")]),
        ("driver license number D1234567", {"entities": ("US_DRIVER_LICENSE",)}, [("US_DRIVER_LICENSE", "D1234567")]),
        ("routing number 021000021", {"entities": ("US_BANK_NUMBER",)}, [("US_BANK_NUMBER", "021000021")]),
        ("to 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", {"entities": ("CRYPTO",)}, [("CRYPTO", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT")]),
        ("Case ID CS-48271 and Case ID CS-48272", {"allowlist": ("case id cs-48271",)}, [("GENERIC_ID", "CS-48272")]),
        ("Attending: CALDER, MIRA", {"profile": "hipaa-safe-harbor"}, []),
        ("Patient CALDER, MIRA", {"profile": "hipaa-safe-harbor"}, [("PERSON", "CALDER"), ("PERSON", "MIRA")]),
    ],
)
def test_detectors(spark, text, kw, expected):
    assert found(spark, text, **kw) == expected


def masked(spark, texts, propagate, **kw):
    out = mask(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], UNITS), policy(**kw), propagate=propagate)
    return [r["masked"] for r in out.orderBy("unit").collect()]


def test_proven_values_are_carried_over(spark):
    texts = ["about CUS-4827-9136 and Calder, total", "Customer ID: CUS-4827-9136\nCALDER, MIRA\nMontgomery, Ann", "(cus-4827-9136) Calder's Montgomeri 7318601O4", "Account 731860104"]
    assert masked(spark, texts, None)[0] == texts[0] and masked(spark, texts, None)[2] == texts[2]
    job = masked(spark, texts, "job")
    assert job[0] == "about <ID#0> and <NAME#0>, total"
    assert job[2] == "(<ID#0>) <NAME#4> <NAME#5> <ACCT#0>"  # a word with an 's is spelt nearly as the word
    seen = masked(spark, texts, "seen")
    assert seen[0] == texts[0] and seen[2].startswith("(<ID#0>) <NAME#") and seen[2].endswith(" 7318601O4")
    assert masked(spark, texts, "job", allowlist=("about cus-4827-9136 and",))[0] == "about CUS-4827-9136 and <NAME#0>, total"


def test_professionals_are_kept(spark):
    texts = ["Attending: CALDER, MIRA", "Guarantor: STONE, ANN\nseen by CALDER, MIRA", "Stone was seen by Calder at Stone Clinic", "Physician: HILL, STONE"]
    kept = masked(spark, texts, "job", profile="hipaa-safe-harbor")
    assert kept[0] == texts[0] and kept[3] == "Physician: HILL, <NAME#0>"
    assert kept[1].endswith("seen by CALDER, MIRA") and kept[1].startswith("Guarantor: <NAME#0>")
    assert "Calder" in kept[2] and kept[2].startswith("<NAME#0> was")


def test_gate_1_finds_what_is_left(spark):
    rows = [(0, "we met Calder. He left"), (1, "met José there"), (2, "call (202) 555-0147 now"), (3, "id A/1234-B here"), (4, "Anna Calder came"), (5, "xA/1234-By"), (6, "see <EMAIL#0> email"), (None, "id ZZ-99812")]
    names = [(0, "PERSON", "CALDER"), (1, "PERSON", "José"), (2, "PHONE_NUMBER", "(202) 555-0147"), (3, "GENERIC_ID", "A/1234-B"), (4, "PERSON", "Anna Calder"), (5, "GENERIC_ID", "A/1234-B"), (6, "GENERIC_ID", "EMAIL"), (None, "GENERIC_ID", "ZZ-99812"), (3, "DATE", "here")]
    m, f = spark.createDataFrame(rows, "unit long, masked string"), spark.createDataFrame(names, "unit long, entity string, text string")
    assert sorted(((r["unit"], r["value"]) for r in left_values(m, f).collect()), key=repr) == sorted([(2, "202) 555-0147"), (3, "a/1234-b"), (4, "anna calder"), (6, "email"), (None, "zz-99812")], key=repr)
    assert {r["unit"] for r in left_names(m, f).collect()} == {0, 1}


def test_flags_and_seeds(spark):
    m = spark.createDataFrame([(0, "010203 and 123456789 and 92@01 and ab.cd@example.net 05/17/2023 and 150.00 4904")], "unit long, masked string")
    flags = {r["value"] for r in pattern_flags(m).collect()}
    assert "unmasked date-shaped run: 010203" in flags and "unmasked 9-digit run in output" in flags
    assert {(r["key"], r["entity"]) for r in seeds_of(left_patterns(m)).collect()} == {("ab.cd@example.net", "ACCOUNT_NUMBER"), ("05/17/2023", "DATE")}


def test_types(spark):
    names = {"dob": "DATE", "Fax:": "PHONE_NUMBER", "ZIP_code": "LOCATION", "US_SSN": "US_SSN", "Date of Birth": "DATE", "account-number": "ACCOUNT_NUMBER", "": None, "nothing": None, None: None}
    df = spark.createDataFrame([(k,) for k in names], "n string").select("n", X.canonical_type(F.col("n")).alias("t"))
    assert {r["n"]: r["t"] for r in df.collect()} == names


def test_fields_of_a_model(spark):
    replies = [(0, 'Sure: {"fields": [{"label": "Name", "value": "Mira Calder", "type": "full name"}, "odd", {"value": "no label"}, {"label": "MRN", "value": "MRN: A-1234 etc", "type": "record number"}, {"label": "Total", "value": "1,200.00"}]} done'), (1, '{"fields": {"a": {"label": "Mail", "value": "ab@example.net", "type": "email"}}}'), (2, "nothing"), (3, '{"fields": 5}')]
    f = fields_of(spark.createDataFrame(replies, "unit long, reply string"))
    assert {(r["unit"], r["label"], r["entity"]) for r in f.collect()} == {(0, "Name", "PERSON"), (0, "MRN", "GENERIC_ID"), (0, "Total", ""), (1, "Mail", "EMAIL_ADDRESS")}
    units = spark.createDataFrame([(0, "Name: Mira  Calder, MRN A-1234 total 1,200.00", ""), (1, "none here", "")], UNITS)
    spans = grounded(f, units)
    assert {(r["unit"], r["s"]["entity"], r["s"]["text"], r["s"]["start"]) for r in spans.collect()} == {(0, "PERSON", "Mira", 6), (0, "PERSON", "Calder", 12), (0, "GENERIC_ID", "A-1234", 24)}
    both = with_fields(detect(units), spans).filter("unit = 0").first()["spans"]
    assert {"Mira", "A-1234"} <= {s["text"] for s in both}
    assert model_spec("gemma4:31b").provider == "ollama" and model_spec("vllm:a/b").model == "a/b" and model_spec("gpt-5").provider == "openai"
    with pytest.raises(ValueError):
        model_spec("openai-compatible:m")


def test_positioned_tables(spark):
    rows = [("Customer", 0.10, 0.10, 0.18), ("ID", 0.19, 0.10, 0.22), ("CUS-4827", 0.24, 0.10, 0.34), ("Account", 0.24, 0.085, 0.30), ("46", 0.60, 0.10, 0.62), ("Age", 0.55, 0.10, 0.58)]
    t = spark.createDataFrame([(0, 0, i, int(y < 0.1), x0, y, x1, y + 0.012, w) for i, (w, x0, y, x1) in enumerate(rows)], "unit long, page int, tok int, line int, x0 double, y0 double, x1 double, y1 double, text string")
    assert {(r["entity"], r["text"]) for r in labelled_values(t, policy()).collect()} == {("GENERIC_ID", "CUS-4827"), ("AGE", "46")}
    s = segment_texts(t.filter("line = 0").withColumn("seg", F.lit(0))).first()
    assert s["text"] == "Customer ID CUS-4827 Age 46" and s["tokens"][2]["start"] == 12
    spans = spark.createDataFrame([(0, 0, 7, 9, 14)], "unit long, page int, span int, start int, end int").join(segment_texts(t.filter("line = 0").withColumn("seg", F.lit(0))).select("unit", "tokens"), "unit")
    assert localised(spans, t).first()["text"] == "ID CUS-4827"
    w = words_of_lines(spark.createDataFrame([(0, 0, 0, "ab  cd", 0.0, 0.0, 0.6, 0.1)], "unit long, page int, line int, text string, x0 double, y0 double, x1 double, y1 double"))
    assert [(r["text"], round(r["x0"], 6), round(r["x1"], 6)) for r in w.orderBy("nth").collect()] == [("ab", 0.0, 0.3), ("cd", 0.3, 0.6)]
    boxes = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.2, 0.2), (0, 0, 0.3, 0.0, 0.5, 0.2), (0, 0, 0.1, 0.1, 0.4, 0.15), (0, 0, 0.8, 0.8, 0.9, 0.9)], "unit long, page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(tuple(r)[2:] for r in merged_regions(boxes).collect()) == [(0.0, 0.0, 0.5, 0.2), (0.8, 0.8, 0.9, 0.9)]
    again = t.union(t.withColumns({"tok": F.col("tok") + 10, "text": F.upper("text"), "x0": F.col("x0") + 0.001}))
    assert without_repeats(again).count() == 6
    money = spark.createDataFrame([(0, 1, 0, "12"), (0, 1, 1, "1,200.00"), (0, 2, 2, "5.00")], "unit long, span int, tok int, text string")
    assert {r["text"] for r in without_money(money).collect()} == {"12", "5.00"}
    assert [r["text"] for r in barcode_spans(money.withColumn("text", F.concat("text", F.lit("x123456")))).limit(1).collect()] == ["12x123456"]
    assert needs_ocr(spark.createDataFrame([(0, 0, 30), (0, 1, 5), (1, 0, 20)], "unit long, page int, n_chars int")).filter("needed").first()["unit"] == 0
    assert signature_regions(t.withColumn("text", F.when(F.col("tok") == 0, "Signed:").otherwise(F.col("text")))).count() == 1


def test_ink():
    grey = np.full((10, 40), 255, np.uint8)
    grey[2:8, 2:10], grey[2:8, 11:14], grey[1:9, 20:36] = 0, 0, 0
    assert ink.ink_runs(grey) == [(2, 14), (20, 36)]
    assert ink.words_by_ink("ab cd", grey) == [("ab", (0.05, 0.2, 0.35, 0.8)), ("cd", (0.5, 0.1, 0.9, 0.9))]
    assert [w for w, _ in ink.words_by_ink("abcdefg", grey)] == ["abc", "defg"] and ink.words_by_ink("a b c", grey) is None
    whole = (0.0, 0.0, 1.0, 1.0)
    assert abs(ink.ink_share(grey, whole) - (66 + 128) / 400) < 1e-9
    assert abs(ink.unread_share(grey, [("word", (0.5, 0.0, 1.0, 1.0), 0.9), ("x7", (0.0, 0.0, 0.5, 1.0), 0.9)], whole) - 66 / 400) < 1e-9
    assert ink.signed(grey, [], [whole, (0.0, 0.0, 0.04, 1.0)]) == [whole]


def test_own_detector(spark):
    units = spark.createDataFrame([(0, "find ABC here", "")], UNITS)
    own = lambda df: df.withColumn("spans", pattern_spans(F.col("text"), "ABC", "GENERIC_ID", 0.9, "custom", 1))
    assert mask(units, detector=own).first()["masked"] == "find <ID#0> here"
    assert mask(units, policy(tag_template="[{entity}-{index}]", short_names=False), detector=own).first()["masked"] == "find [GENERIC_ID-0] here"


def test_scores(spark):
    schema = "unit long, page int, box int, x0 double, y0 double, x1 double, y1 double, entity string"
    truth = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 0.2, 0.1, "PERSON"), (0, 0, 1, 0.5, 0.5, 0.7, 0.6, "FACE"), (1, 0, 0, 0.0, 0.0, 0.1, 0.1, "AGE")], schema)
    drawn = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 0.1, 0.1), (0, 0, 1, 0.08, 0.0, 0.18, 0.1), (0, 0, 2, 0.9, 0.9, 1.0, 1.0)], schema.replace(", entity string", ""))
    r = {x["unit"]: x for x in scores(truth, drawn).collect()}
    assert (r[0]["n_missed"], r[0]["n_under_masked"], round(r[0]["hit_precision"], 4), r[0]["hit_recall"]) == (1, 0, 0.6667, 0.5)
    assert (r[1]["area_recall"], r[1]["area_precision"], r[1]["n_missed"]) == (0.0, 1.0, 1)
    t = lambda s: spark.createDataFrame([(0, s)], "unit long, text string")
    v = spark.createDataFrame([(0, "(402) 738-5912"), (0, "Mira"), (0, "absent")], "unit long, value string")
    x = identity_scores(t("Call Mira at 402 738 5912 about lunch"), t("Call Mira at <PHONE#0> about"), v).first()
    assert (x["n_values"], x["n_leaked"], x["recall"], x["unreadable"], x["over_masked"]) == (2, 1, 0.5, 1, 0.25)


def test_stream(spark, tmp_path):
    src, out, tags = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "tags")
    first = spark.createDataFrame([(0, "ab@example.net", ""), (1, "cd@example.net ab@example.net", "")], UNITS)
    first.coalesce(1).write.parquet(str(src))
    for _ in range(2):
        mask_stream(spark.readStream.schema(first.schema).parquet(str(src)), out, tags, str(tmp_path / "cp"), MAIL).awaitTermination()
        spark.createDataFrame([(None, "zz@example.net cd@example.net", ""), (0, "202-555-0147", "")], UNITS).coalesce(1).write.mode("append").parquet(str(src))
    rows = {(r["unit"], r["masked"]) for r in spark.read.parquet(f"{out}/clean").collect()}
    assert rows == {(0, "<EMAIL#0>"), (1, "<EMAIL#1> <EMAIL#0>"), (None, "<EMAIL#2> <EMAIL#1>")}
    assert [r["masked"] for r in spark.read.parquet(f"{out}/held").collect()] == ["202-555-0147"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("Customer ID: CUS-4827-9136")
    (tmp_path / "b.csv").write_text("note,customer id\nabout cus-4827-9136,CUS-1111-2222\n")
    out = str(tmp_path / "out")
    assert main([str(tmp_path / "a.txt"), str(tmp_path / "b.csv"), "-o", out, "--propagate", "job", "--report", str(tmp_path / "r.json")], spark) == 0
    assert (tmp_path / "out/a.txt").read_text() == "Customer ID: <ID#0>" and (tmp_path / "out/b.csv").read_text() == "note,customer id\nabout <ID#0>,<ID#1>\n"
    assert "2 of 2 files masked, 3 values" in capsys.readouterr().out and len(json.load(open(tmp_path / "r.json"))) == 2
    assert main([str(tmp_path / "a.pdf"), "-o", out], spark) == 2
    (tmp_path / "c.txt").write_text("ab.cde@example.net")
    assert main([str(tmp_path / "c.txt"), "-o", out, "--entities", "PERSON"], spark) == 1 and not (tmp_path / "out/c.txt").exists()
