"""Case tables for the column functions; each row is one rule."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from wayfold.functions import headers as H
from wayfold.functions import names as N
from wayfold.functions import packs as K
from wayfold.functions import pyrules as Y
from wayfold.functions import redaction as R
from wayfold.functions import shapes as S
from wayfold.functions import urls as U


def column(spark, values, expr, kind="string"):
    """The expression over ``v``, one result per input, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def cases(spark, expr, table, kind="string"):
    assert column(spark, list(table), expr, kind) == list(table.values())


def test_credentials(spark):
    no = ["LLPIN", "User ID, CIN, LLPIN, FCRN or Email ID", "pinCode", "Pin code", "Pincode", "pin-code", "PIN Code", "spinner", "shipping", "pinned", "userPinned", "address1"]
    yes = ["PIN", "Pin", "userPin", "txnPin", "user_pin", "login PIN", "PIN2", "mpin", "MPIN", "otp", "Enter the OTP", "captcha", "cvv", "Password", "passcode"]
    cases(spark, R.is_credential(F.lit("text"), "v"), {**{v: False for v in no}, **{v: True for v in yes}})


def test_text_rules(spark):
    cases(spark, R.scrub_expr("v"), {
        "4111 1111 1111 1111": "<CARD>", "1234567890123456": "1234567890123456", "4111 1111 1111 1112": "<PHONE> 1112",
        "mail a.b@c.co.uk now": "mail <EMAIL> now", "Bearer abc.def": "Bearer <TOKEN>", "sk-abcdefghijklmnop1": "<TOKEN>", "GB33BUKB20201555555555": "<IBAN>", "id 192.168.100.1": "id <PHONE>", "id 10.0.0.1": "id 10.0.0.1",
    })
    cases(spark, R.scrub_expr("v", ("india",)), {"x_AST_ABCDE1234F_Notice.pdf": "x_AST_<PAN>_Notice.pdf", "22AAAAA0000A1BZ5": "<GSTIN>", "12345678": "<DIN>", "SBIN0001234": "<IFSC>"})


def test_python_and_native_rules_agree(spark):
    texts = ["a@b.co 4111111111111111 +91 98765 43210", "eyJhbGciOiJIUzI1NiJ9.abc.def", "plain", "AIzaSyA1234567890123456789012", "22AAAAA0000A1BZ5 ABCDE1234F 2345 6789 0123"]
    for packs in (("generic",), ("generic", "india")):
        native = column(spark, texts, R.scrub_expr("v", packs))
        assert native == [Y.Scrubber(packs).text(t) for t in texts]


def test_scrubbing_twice_changes_nothing(spark):
    texts = ["a@b.co and 4111 1111 1111 1111", "Bearer xyz", "call +1 (555) 123-4567 x"]
    once = column(spark, texts, R.scrub_expr("v"))
    assert column(spark, once, R.scrub_expr("v")) == once


def test_packs_of_a_row_and_own_packs(spark):
    K.register_pack(K.Pack("tickets", rules=(K.TextRule("ticket", r"T-[0-9]+", "<TICKET>"),)))
    cases(spark, R.scrub_expr("v", ("tickets",)), {"see T-12": "see <TICKET>"})
    cases(spark, F.array_join(R.packs_for_origin("v"), ","), {"https://a.gov.in": "generic,india", "https://a.in:8443": "generic,india", "https://a.com": "generic"})
    got = column(spark, ["ABCDE1234F"], R.scrub_for_packs("v", F.array(F.lit("generic"), F.lit("india"))))
    assert got == ["<PAN>"] and column(spark, ["ABCDE1234F"], R.scrub_for_packs("v", F.array(F.lit("generic")))) == ["ABCDE1234F"]


def test_ids_in_addresses(spark):
    cases(spark, U.template_segment("v"), {"1043": "{id}", "550e8400-e29b-41d4-a716-446655440000": "{id}", "0123456789abcdef": "{id}", "<PAN>": "{id}", "getAccountSummaryV2": "getAccountSummaryV2", "orders": "orders", "12.pdf": "{id}.pdf", "{id}": "{id}"})


def test_addresses(spark):
    cases(spark, U.origin_of("v"), {"https://u@Ex.com:443/a": "https://ex.com", "http://h:8080": "http://h:8080", "ftp://x": None, "mailto:a": None, "HTTP://H:80/": "http://h"})
    cases(spark, U.template_url("v", F.lit("https://b.com/")), {"/x//1043;s=1/y?a=1": "https://b.com/x/{id}/y", "//h/p": "https://h/p", "mailto:x": "mailto:x", "https://h/a%20b": "https://h/a b", "https://h/a+b/%zz": "https://h/a+b/%zz"})
    cases(spark, U.route_of("v", packs=None), {"https://h/p?q=1#/r/s?z=1": "/p#/r/s", "https://h#top": "/", "https://h/#!/x": "/#!/x"})
    cases(spark, F.array_join(U.query_keys("v", packs=None), ","), {"https://h/?b=1&a=2&a=3#/r?c=1": "a,b,c", "https://h/?x+y=1": "x y"})
    cases(spark, U.clean_href("v", F.lit("https://e.com/x/y/z?p=1")), {"../b?q=1": "/x/b", "#/r?x": "/x/y/z#/r", "#top": None, "//o.com/z/": "https://o.com/z/", "c/./d": "/x/y/c/d", "javascript:void(0)": None, "?a=1": "/x/y/z"})
    cases(spark, U.scrub_url("v", True), {"https://h/Doc_123456.pdf?x=1#/o/1234567": "https://h/{id}.pdf#/o/{id}", "https://h/annual-report-page": "https://h/annual-report-page", "blob:x": None})


def test_paging_names(spark):
    cases(spark, U.is_paging_param("v"), {"page": True, "pageSize": True, "page[size]": True, "nextPageToken": True, "maxResults": True, "size": True, "resize": False, "first_name": False, "status": False})
    cases(spark, U.is_position_param("v"), {"page": True, "pageSize": False, "offset": True, "limit": False, "cursor": True})
    cases(spark, U.write_verb("v"), {"updateEntity": "update", "getStatus": None, "bulk_delete": "delete"})


def test_names(spark):
    cases(spark, N.name_shape("v"), {"AB12_2024.pdf": "A{2}9{2}_9{4}.pdf", "C:\\x\\Résumé.docx": "A{6}.docx", "statement.surname": "A{9}.A{7}"})
    cases(spark, N.is_danger("v"), {"Pay": True, "Pay now": True, "Payments": False, "Submitted": False, "Löschen, delete": True})
    cases(spark, N.classify_id("v").isNotNull(), {"mat-input-3": True, "input-12": True, "550e8400-e29b-41d4-a716-446655440000": True, "address1": False, "dob2": False})
    cases(spark, N.identifier("v"), {"step two": "stepTwo", "2nd": "_2nd", "class": "_class", "": "_"})
    cases(spark, N.format_of("v"), {"2024-01-02": "date", "2024-01-02T10:00": "datetime", "1,234.5": "numeric", "yes": "boolean", "//x/y": "url", "a@b.c": "email", "hello": "text"})
    assert column(spark, [500, 2048, 3 * 1024 * 1024, -1], N.human_bytes("v"), "long") == ["500 B", "2 KB", "3.0 MB", "size unknown"]
    assert column(spark, [400, 61_000, 7_200_000], N.human_duration("v"), "long") == ["1 seconds", "1 minutes", "2.0 hours"]


def test_headers(spark):
    df = spark.createDataFrame([([("Content-Type", "application/pdf; x"), ("content-disposition", 'attachment; filename="Asha.PDF"'), ("Content-Length", "12")],)], "h array<struct<name:string,value:string>>")
    r = df.select(H.mime_of("h").alias("m"), H.content_length("h").alias("n"), H.content_disposition("h").alias("d"), H.without_file_names("h").alias("c"), H.is_download("h").alias("s")).first()
    assert (r.m, r.n, r.d.kind, r.d.ext, r.s) == ("application/pdf", 12, "attachment", "pdf", True)
    assert r.c[1].value == "attachment; filename=<redacted>.pdf"


def test_cut_bodies_with_long_keys_and_numbers(spark):
    long = "x" * 200 + "_mobile"
    cases(spark, Y.scrub_json("v"), {
        f'{{"{long}":"98450 12345","tr': f'{{"{long}":"<PHONE>","tr',
        '{"dob":' + "9" * 30 + ',"tr': '{"dob":"<DATE>","tr',
    })
    # escaped quotes without end are read once
    begun = time.perf_counter()
    Y.Scrubber(("generic",)).body('{"a":"' + r"\"" * 200_000)
    assert time.perf_counter() - begun < 20


def test_deep_json_equals_the_parser():
    rng = random.Random(3)

    def value(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice([None, True, 1.5, -3, 'a"b', "é\\", ""])
        if rng.random() < 0.5:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice('abc"') * rng.randint(0, 2): value(depth - 1) for _ in range(rng.randint(0, 3))}

    def read(parser, text):
        try:
            return repr(parser(text))
        except ValueError:
            return None

    for _ in range(3000):
        text = json.dumps(value(4), indent=rng.choice([None, 2]))
        if rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", ",", "}", "]", '"', ":"]) + text[at + 1 :]
        assert read(json.loads, text) == read(S.parse_deep, text)
    deep = "[" * 200_000 + "7" + "]" * 200_000
    with pytest.raises(RecursionError):
        json.loads(deep)
    rows = list(S.ShapeVisits().eval(deep, 1000, None, None, None))
    assert len(rows) == 1001 and rows[999][3] == "array" and rows[1000][3] == "truncated"
    assert [r[3] for r in S.ShapeVisits().eval(deep[197_000:203_001], None, None, None, None)][-1] == "number"


def test_json_bodies(spark):
    cases(spark, Y.scrub_json("v"), {
        '{"dueDate":1790000000000}': '{"dueDate":1790000000000}', '{"mobile":1790000000000}': '{"mobile":"<PHONE>"}', '{"contactFirstName":"A B","nameOfAssessee":"C"}': '{"contactFirstName":"<NAME>","nameOfAssessee":"<NAME>"}',
        '{"formName":"x","serviceName":"y","bankName":"z"}': '{"formName":"x","serviceName":"y","bankName":"z"}', '{"dob":19900101}': '{"dob":"<DATE>"}', '{"address":{"l":["a"]}}': '{"address":{"l":["<ADDRESS>"]}}',
        '{"f":"a b.pdf"}': '{"f":"<FILE>.pdf"}', '{"fullName":"A","x":"a@b.co","createdOn":1700000000, "tr': '{"fullName":"<NAME>","x":"<EMAIL>","createdOn":1700000000, "tr', "": "", "plain a@b.co": "plain <EMAIL>",
    })
    assert column(spark, [None], Y.scrub_json("v")) == [None]


@pytest.mark.parametrize("expr", [lambda: U.parse_call_url("v"), lambda: U.scrub_url("v"), lambda: R.scrub_expr("v"), lambda: N.name_shape("v")])
def test_column_functions_stay_in_the_jvm(spark, expr):
    plan = spark.createDataFrame([("x",)], "v string").select(expr())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_hostile_bodies_are_read_to_the_end():
    s = Y.Scrubber(("generic",))
    deep = "[" * 100_000 + '{"fullName":"Asha Rao"}' + "]" * 100_000
    assert "Asha" not in s.body(deep) and len(s.body(deep)) > 200_000
    nested = '{"a":' * 70 + '{"fullName":"Asha Rao","x":1}' + "}" * 70
    assert s.body(nested) == '{"a":' * 70 + '{"fullName":"<NAME>","x":1}' + "}" * 70
    assert s.body('{"n":' + "7" * 400 + "}").startswith('{"n":') and s.body('{"n":1e999,"m":1.5,"k":2.0}') == '{"n":null,"m":1.5,"k":2}'
    assert s.body('{"n":' + "7" * 9000 + ',"mail":"a@b.co"}').endswith('"<EMAIL>"}')
    assert s.body('{"a":NaN,"fullName":"B C"}') == '{"a":NaN,"fullName":"<NAME>"}' and s.body('{"x":"\\ud800","fullName":"B C"}').endswith('"<NAME>"}')
    big = '{"items":[' + ",".join(f'{{"fullName":"P{i}"}}' for i in range(60_000)) + "]" + " " * (5 << 20) + "}"
    assert '"P' not in s.body(big)


def test_cut_bodies_teach_names():
    s, learned = Y.Scrubber(("generic",)), []
    s.body('{"fullName":"Asha Rao","file":"a b.pdf","rows":[{"customerName":"Bina', learned)
    assert learned == [("Asha Rao", "<NAME>")]
    learned.clear()
    s.body('{"fullName":"Asha Rao","list":[{"customerName":"Bina K"}]}', learned)
    assert sorted(learned) == [("Asha Rao", "<NAME>"), ("Bina K", "<NAME>")]
