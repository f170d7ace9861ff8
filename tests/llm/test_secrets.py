import base64
import hashlib
import random
import re

from pyspark.sql import functions as F

from gridlark.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def listed(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def rows():
    rnd = random.Random(4)
    out = [None, "", "secret:token\"=abcdefgh", "tokeN = 'a.b+c/d=' é password=12345 passwd:123456", "AKIAAKIA" + "X" * 20 + " AKIA" + "A" * 15, "AKIA" + "B" * 16, "f" * 24 + "g" + "0" * 23, "API_KEY: " + "9" * 30, "apikey=" + "a" * 40 + "\n🙂secret = x"]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    bits = ["password", "token", "=", ":", " ", '"', "'", "abc", "AKIA", "0123456789abcdef", "ÉÄ", "🙂", ".", "Secret", "api_key", "APIKEY"]
    out += ["".join(rnd.choices(bits, k=rnd.randint(5, 60))) for _ in range(150)]
    out += [f"the key {''.join(rnd.choices(alphabet, k=48))} ends" for _ in range(40)]
    out += [f"see section-number-{i}-of-the-user-manual-and-read-it-well or {'abc' * 12}{i}" for i in range(40)]
    return out + ["x " * 100_000 + "token=abcdef1 " * 300]


def test_base_spans_and_random_keys(spark):
    texts = rows()
    docs = spark.createDataFrame([(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = S.find_secrets(docs).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(texts):
        if i % 9:
            want = base(t)
            assert by[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), (t, by[i].spans)
            assert [by[i].n_assign, by[i].n_access, by[i].n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
            assert not want or set(listed(want).split(",")) <= set(by[i].spans.split(","))
    keys = [r for i, r in by.items() if texts[i] and texts[i].startswith("the key ")]
    plain = [r for i, r in by.items() if texts[i] and texts[i].startswith("see section")]
    assert sum(r.spans == "random:8:56" for r in keys) >= 0.9 * len(keys)
    assert not any(r.n_random for r in plain)


def test_redaction(spark):
    key = base64.b64encode(hashlib.sha512(b"k").digest()).decode()[:48].replace("=", "A")
    rows = [(1, "say token=abcdef12 and AKIA" + "Q" * 20 + "TOKEN=abcdefgh end", 9), (2, None, 0), (3, "plain", 5), (4, "", 0)] + [(9 + i, "k " + "".join(random.Random(i).sample(key, 48)), 50) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = S.redact(docs)
    assert got.columns == docs.columns
    got = {r.doc_id: r for r in got.collect()}
    assert got[1].text == "say [secret] and [secret] end" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[4].text) == (None, "plain", "") and len(got) == len(rows)
    assert sum(got[9 + i].text == "k [secret]" for i in range(30)) >= 24


def test_values_of_base_spans_are_tested(spark):
    """Random values of base spans pass the battery and plain ones don't; the spans are the same either way."""
    rnd = random.Random(3)
    keys = ["token=" + "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(30)] + ["".join(rnd.choices("0123456789abcdef", k=40)) for _ in range(30)]
    plain = ["password = correct-horse-battery-staple-and-more", "token: " + "xyz123" * 8, "secret=" + "Z" * 40] * 10
    docs = spark.createDataFrame([(i, f"set {t} here") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    got = {r.doc_id: r for r in S.find_secrets(docs).collect()}
    assert all(r.n_assign + r.n_hex == 1 == len(r.base_p) == len(r.base_random) for r in got.values())
    assert sum(got[i].base_random[0] for i in range(60)) >= 55 and max(got[i].base_p[0] for i in range(20)) < 0.01
    assert not any(got[60 + i].base_random[0] for i in range(30))


def test_letters_of_the_corpus_calibrate_the_model(spark):
    """In a corpus of other letters the same token is likelier as text."""
    strange = [(i, "zqxjk vwzqj xkqzz " * 400) for i in range(5)]
    docs = spark.createDataFrame(strange, "doc_id long, text string")
    shares = S._letters(docs.select(S.hits(F.col("text")).alias("hits")))
    assert abs(sum(shares) - 100) < 1e-6 and shares[S.ALPHABET.index("z")] > 15 > shares[S.ALPHABET.index("e")]
    token = spark.createDataFrame([("zqxjk7", ["zq", "qx", "xj", "jk", "k7"])], "t string, pairs array<string>")
    own, default = token.select(*(S._structured(F.col("t"), F.col("pairs"), x) for x in (shares, S.LETTERS))).first()
    assert own > default
    assert S.letter_shares(None) == S.letter_shares([0] * 26)


def test_columns_with_the_helpers_names_stay(spark):
    names = "row hits tests spans clean base maybe letters __base __maybe __spans __changed __runs __free id".split()
    docs = spark.createDataFrame([(1, "a token=abcdef12 b", *[f"{n}!" for n in names]), (2, None, *names)], ["doc_id", "text", *names])
    got = {r.doc_id: r for r in S.redact(docs).collect()}
    assert S.redact(docs).columns == docs.columns and got[1].text == "a [secret] b"
    assert [tuple(got[1])[2:], tuple(got[2])[2:]] == [tuple(f"{n}!" for n in names), tuple(names)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.find_secrets(docs).count() == 0 and S.redact(docs).count() == 0


WORDS = "order export service monitoring weekly report customer rechnung bestellung strasse verbindung maison livre facture bonjour trabajo siguiente pedido ventas kubernetes cluster backup archive image thumbnail profile settings network adapter driver module release candidate version summary schedule holiday picture window terminal session account payment invoice delivery".split()


def structured(rnd, n):
    """A token of ``n`` characters made of words, dates, counters or repeats."""
    while True:
        w, num = rnd.choices(WORDS, k=9), str(rnd.choice([rnd.randrange(10), rnd.randrange(1000), rnd.randrange(1990, 2030)]))
        date = f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}T{rnd.randint(0, 23):02}-{rnd.randint(0, 59):02}"
        makes = ["-".join, "_".join, "/".join, "".join, lambda x: "".join(map(str.capitalize, x)), lambda x: "_".join(x).upper(), lambda x: date + "/" + "-".join(x), lambda x: "0" * (n - 4) + f"{rnd.randrange(16**3):03x}a", lambda x: (rnd.choice(["abc1", "x8y2q9wk", "a0b1c2"]) * n)]
        s = rnd.choice(makes)([num, *w])[:n]
        if re.search("[A-Za-z]", s) and re.search("[0-9]", s):
            return s


def random_key(rnd, alphabet, n):
    while True:
        s = "".join(rnd.choices(alphabet, k=n))
        if re.search("[A-Za-z]", s) and re.search("[0-9]", s):
            return s


def test_short_keys_among_many_structured_tokens(spark):
    """Keys are a fiftieth of the tokens of each length class; the lower-case hexadecimal ones of 24 and 32 would be base spans."""
    rnd, upper = random.Random(8), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": upper + "234567", "lower": upper.lower() + "0123456789", "base64": upper + upper.lower() + "0123456789+/"}
    rows = [("", n, structured(rnd, n)) for n in (16, 20, 24, 32) for _ in range(1000)]
    rows += [(kind, n, random_key(rnd, chars, n)) for kind, chars in kinds.items() if kind != "hex" for n in (16, 20, 24, 32) for _ in range(4)]
    rows += [("hex", n, random_key(rnd, kinds["hex"], n)) for n in (16, 20) for _ in range(4)]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.n_random for r in S.find_secrets(docs).collect()}
    keys = {n: [got[i] for i, (kind, m, _) in enumerate(rows) if kind and m == n] for n in (16, 20, 24, 32)}
    assert all(sum(found) >= 0.75 * len(found) for found in keys.values()), keys
    false = [t for i, (kind, _, t) in enumerate(rows) if not kind and got[i]]
    assert len(false) <= 0.05 * (len(false) + sum(map(sum, keys.values()))), false
