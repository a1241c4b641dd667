import hashlib
import re

from anonframe.llm.pii import ANY, pseudonymize
from pyspark.sql import functions as F

from .fixtures import documents, rows


KEY = "a secret"


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def one(spark, texts, key=KEY):
    return [r["text"] for r in pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), key).orderBy("doc_id").collect()]


def brute_text(value, tweak, letters=26, key=KEY):
    """The Feistel network, character by character."""

    def shift(text, mac):
        out = ""
        for i, c in enumerate(text):
            by = int(mac[i % 42 * 3 : i % 42 * 3 + 3], 16)
            for first, size in (("0", 10), ("a", letters), ("A", letters)):
                if first <= c <= chr(ord(first) + size - 1):
                    c = chr((ord(c) - ord(first) + by) % size + ord(first))
                    break
            out += c
        return out

    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(10):
        mac = hashlib.sha512("\x1f".join([key, tweak, str(i), left if i % 2 else right]).encode()).hexdigest()
        left, right = (left, shift(right, mac)) if i % 2 else (shift(left, mac), right)
    return left + right


def test_known_network_and_formats(spark):
    got = one(spark, ["mail von.34@mail7.example.com, x", "call +1 (017) 555-7713.", "card 4111111111111111 end", "not 4111111111111112 end", "ip 10.1.2.3!", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "on 1987-06-05 born", "on 1987-02-30 no", "ssn 123-45-6789", "GB82 WEST 1234 5698 7654 32 ok", "v 2.0. and 999.1.1.1 stay"])
    assert got[0] == f"mail {brute_text('von.34', 'email')}@mail7.example.com, x"
    assert got[1] == "call +1 ({}{}{}) {}{}{}-{}{}{}{}.".format(*brute_text("0175557713", "phone"))
    card = got[2].split()[1]
    assert card[:-1] == brute_text("411111111111111", "card") and luhn(card)
    assert got[3] == "not 4111111111111112 end"
    assert got[4] != "ip 10.1.2.3!" and all(0 <= int(x) < 256 for x in got[4][3:-1].split("."))
    assert got[5] == f'token = "{brute_text("04dbebab91ab85687d33eeaaf9ac699e1188f962", "hex", 6)}" x'
    assert re.fullmatch(r"on (19|20)\d\d-\d\d-\d\d born", got[6]) and got[6] != "on 1987-06-05 born"
    assert got[7] == "on 1987-02-30 no"
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", got[8]) and got[8] != "ssn 123-45-6789"
    iban = got[9][:-3].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and got[9] != "GB82 WEST 1234 5698 7654 32 ok"
    assert got[10] == "v 2.0. and 999.1.1.1 stay"


def test_permutation_and_links(spark):
    ips = [f"10.0.{i}.{j}" for i in range(8) for j in range(50)]
    assert len(set(one(spark, ips))) == len(ips)
    days = [f"20{y:02}-{m:02}-15" for y in range(30) for m in range(1, 13)]
    assert len(set(one(spark, days))) == len(days)
    mails = [f"a{i}@x.org" for i in range(10)]
    assert sorted(one(spark, mails)) == sorted(one(spark, one(spark, mails))) or len(set(one(spark, mails))) == 10
    a, b, c = one(spark, ["x bob.1@a.com", "bob.1@a.com y", "Bob.1@a.com"])
    assert a[2:] == b[:-2] and a[2:] != c
    assert one(spark, ["bob@a.com"], key="k2") != one(spark, ["bob@a.com"])


def test_whole_texts_keep_everything_else(spark, sf):
    docs = documents(spark, sf, 200)
    before = dict(rows(docs))
    out = pseudonymize(docs, KEY)
    assert out.columns == [*docs.columns, "pii_kinds"]
    changed = 0
    for r in out.collect():
        t, u = before[r["doc_id"]], r["text"]
        if t is None:
            assert u is None and r["pii_kinds"] == []
            continue
        keep = lambda s: re.split("|".join(f"(?:{p})" for p in [ANY]), s)
        assert (t == u) == (not r["pii_kinds"])
        assert keep(t) == keep(u)
        changed += t != u
    assert changed > 3


def test_edges(spark):
    assert pseudonymize(spark.createDataFrame([], "doc_id long, text string, pii_kinds string"), KEY).count() == 0
    long_text = "word " * 100_000 + "a.b@c.org"
    out = pseudonymize(spark.createDataFrame([(1, long_text)], "doc_id long, text string"), KEY).select(F.length("text").alias("n"), "pii_kinds").first()
    assert out["n"] == len(long_text) and out["pii_kinds"] == ["email"]


def test_shorter_cards_and_ibans(spark):
    inside = {
        "card 4111 1111 1111 1111 12/27 end": "4111 1111 1111 1111",
        "n 4111111111111111123 end": "4111111111111111",
        "n 12 4111-1111-1111-1111 99 end": "4111-1111-1111-1111",
        "a 3782 822463 10005 2024-01-02 end": "3782 822463 10005",
        "to ES91 2100 0418 4502 0005 1332 BIC end": "ES91 2100 0418 4502 0005 1332",
        "to GB82WEST12345698765432 BIC end": "GB82WEST12345698765432",
        "\uffff\ufffe ES91 2100 0418 4502 0005 1332 DE89 3704 0044 0532 0130 00 BIC \uffff": "DE89 3704 0044 0532 0130 00",
    }
    got = one(spark, list(inside))
    for (text, value), new in zip(inside.items(), got, strict=True):
        lead, rest = text.split(value)
        assert value not in new and len(new) == len(text), new
        assert new.startswith(lead[:5]) and new.endswith(rest[-4:])
    assert got[0][:5] == "card " and got[0][-10:] == " 12/27 end" and luhn(got[0][5:24].replace(" ", ""))
    assert got[1][-7:] == "123 end" and luhn(got[1][2:18])
    assert "2024-01-02" not in got[3]  # what follows is read again
    assert got[4][-8:] == " BIC end"
    assert "ES91 2100" not in got[6] and got[6][:2] == "\uffff\ufffe"
    assert one(spark, ["4111 1111 1111 1112 10", "ES92 2100 0418 4502 0005 1332 BIC"]) == ["4111 1111 1111 1112 10", "ES92 2100 0418 4502 0005 1332 BIC"]


def test_secrets_of_any_length(spark):
    for n in (8, 256, 257, 300, 5000):
        value = ("aZ09_-." * n)[:n]
        assert one(spark, [f'token = "{value}" end']) == [f'token = "{brute_text(value, "secret")}" end']
    assert one(spark, ['token = "' + "a" * 300 + " end"]) == ['token = "' + "a" * 300 + " end"]


def test_layouts_stay_linked(spark):
    bare = lambda s: re.sub("[^0-9A-Z]", "", s)
    cards = one(spark, ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"])
    assert len({bare(c) for c in cards}) == 1 and luhn(cards[0]) and cards[0] != "4111111111111111"
    assert [re.sub("[0-9]", "9", c) for c in cards] == ["9" * 16, "9999 9999 9999 9999", "9999-9999-9999-9999"]
    ibans = one(spark, ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"])
    assert bare(ibans[0]) == bare(ibans[1]) and ibans[1][4] == ibans[1][9] == " " and bare(ibans[0]) != "GB82WEST12345698765432"
    phones = one(spark, ["+1 (415) 555-7713", "+1-415-555-7713", "+14155557713", "(415) 555-7713", "+49 415 555 7713"])
    assert len({bare(p)[-10:] for p in phones}) == 1 and {bare(p)[:-10] for p in phones} == {"1", "", "49"}
    assert len({bare(p) for p in one(spark, [f"+1 415 555 {i:04}" for i in range(300)])}) == 300


def brute_number(x, a, b, tweak):
    left, right = divmod(x, b)
    for i in range(10):
        mac = int(hashlib.sha512("\x1f".join([KEY, tweak, str(i), str(left if i % 2 else right)]).encode()).hexdigest()[:14], 16)
        left, right = (left, (right + mac) % b) if i % 2 else ((left + mac) % a, right)
    return left * b + right


def test_numbers_against_a_plain_network(spark):
    import datetime

    ip, day, ssn = one(spark, ["10.1.2.3", "1987-06-05", "123-45-6789"])
    x = brute_number(int.from_bytes(bytes([10, 1, 2, 3]), "big"), 1 << 16, 1 << 16, "ip")
    assert ip == ".".join(map(str, x.to_bytes(4, "big")))
    first = datetime.date(1900, 1, 1)
    assert day == str(first + datetime.timedelta(brute_number((datetime.date(1987, 6, 5) - first).days, 17, 4297, "date")))
    x = brute_number(122 * 99 * 9999 + 44 * 9999 + 6788, 898, 99 * 9999, "ssn")
    area = x // (99 * 9999) + 1
    assert ssn == f"{area + (area >= 666):03}-{x % (99 * 9999) // 9999 + 1:02}-{x % 9999 + 1:04}"


def test_rows_that_repeat_nulls_and_no_key(spark):
    import pytest

    df = spark.createDataFrame([(1, None, "z"), (1, None, "z"), (None, "", "z"), (None, "a.b@c.org", "z")], "doc_id long, text string, kind string")
    out = pseudonymize(df, KEY).collect()
    assert sorted((r["text"] or "", len(r["pii_kinds"])) for r in out)[:3] == [("", 0)] * 3 and all(r["kind"] == "z" for r in out)
    with pytest.raises(ValueError):
        pseudonymize(df, "")
