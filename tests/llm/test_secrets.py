"""The log-likelihood ratios of secret scans against a version in plain Python."""

import math
import random
import re
import string
from collections import Counter

from quantloom.llm import secrets
from quantloom.llm.common import table

RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}", re.ASCII)


def samples(texts):
    """Labelled values of the corpus: those of the fixed patterns, and all other words, plain and as compounds."""
    random_, plain = [], []
    for text in texts:
        chars = list(text)
        for span in secrets.base_spans(text):
            random_.append(secrets._value(text, span))
            chars[span[1] : span[2]] = " " * (span[2] - span[1])
        rest = "".join(chars)
        plain.append(RUN.sub(lambda m: " " * len(m[0]) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) else m[0], rest))
    words = " ".join(plain)
    ascii_only = lambda f: f(words.encode("latin-1", "replace")).decode("latin-1")
    return [words, *(words.replace(" ", c) for c in "_-/"), ascii_only(bytes.title).replace(" ", ""), ascii_only(bytes.upper).replace(" ", "_")], [" ".join(random_)]


def trigrams(value):
    """(two before, one before, character) of each symbol; a border where there is none."""
    out = []
    for i, c in enumerate(value):
        if c in secrets.SYMBOLS:
            b = value[i - 1] if i and value[i - 1] in secrets.SYMBOLS else ""
            a = value[i - 2] if i > 1 and b and value[i - 2] in secrets.SYMBOLS else ""
            out.append((a, b, c))
    return out


def log_probability(values):
    three = Counter(t for v in values for t in trigrams(v))
    pairs, singles = Counter(), Counter()
    for (_, b, c), n in three.items():
        pairs[b, c] += n
        singles[c] += n
    symbols = ["", *secrets.SYMBOLS]
    one = {c: singles[c] + 1.0 for c in symbols}
    total = sum(one.values())

    def two(b, c):
        row = sum(pairs[b, x] for x in symbols) + len(symbols)
        return (pairs[b, c] + len(symbols) * one[c] / total) / row

    return lambda a, b, c: math.log((three[a, b, c] + 16 * two(b, c)) / (sum(three[a, b, x] for x in symbols) + 16))


def test_ratios_like_plain_python(spark):
    r = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    words = ["manager", "connection", "identifier", "configuration", "value_of_things", "getElementById", "internationalization"]
    texts = [" ".join(r.choice(words) for _ in range(60)) + f" password = {key(24)} and token: {key(32)}" for _ in range(40)]
    texts += [f"see {key(30)} and {key(16)} or internationalization", "ünï " + key(40) + " é", "", "------------------ ============"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, None), (100, None)], "doc_id long, text string")
    found = secrets.scan_secrets(df, least_ratio=0.5).collect()
    assert len(found) == len(texts) + 2
    plain, random_ = (log_probability(v) for v in samples(texts))
    n = 0
    for row in found:
        text = texts[row.doc_id] if row.doc_id < 100 else ""
        base = secrets.base_spans(text)
        expected = set(base)
        for m in RUN.finditer(text):
            if re.search("[A-Za-z]", m[0]) and all(m.end() <= s or m.start() >= e for _, s, e in base):
                if sum(random_(*t) - plain(*t) for t in trigrams(m[0])) / len(m[0]) > 0.5:
                    expected.add(("markov", *m.span()))
                    n += 1
        assert {(s.kind, s.start, s.end) for s in row.spans} == expected
    assert n == 3  # the keys without a name


ORDINARY = """
2024-01-30T12-00-00Z 20240130T120000Z 2024-01-30/12-00-00/log1 IMG_20240130_120000 version-10-2-3-beta4 windows-10-x64-build-19045 x86_64-linux-gnu-gcc-12 spark-sql-kafka-0-10_2-13
XMLHttpRequest2 getElementsByTagName ThreadPoolExecutor2 TestCase_0042_Part3 HTTP_STATUS_404_NOT_FOUND user_id_1234567 utf8mb4_general_ci_2 internationalization ISO-8859-15-variant
application/json-patch application/vnd_ms-excel text/html-charset-utf-8 org/apache/commons/lang3 node_modules/react-dom/v18 /usr/local/lib/python3 1234567890123456a AAAAAAAAAAAAAAAA ----------BEGIN----------
""".split()


def test_precision_and_recall_on_a_labelled_list(spark):
    """With the shipped threshold and models trained on the documents: ordinary strings are no secrets, random keys of 16 and more characters are."""
    model = secrets.train(table(spark, "/root/testdata/sf0.01", "documents"))
    r = random.Random(11)
    letters = string.ascii_letters + string.digits
    keys = {(kind, n): ["".join(r.choice(chars) for _ in range(n)) for _ in range(300)] for kind, chars in (("alphanumeric", letters), ("base64", letters + "+/"), ("hex", "0123456789abcdef")) for n in (16, 20, 24, 31)}
    rows = [(i, f"see {w} there") for i, w in enumerate([*ORDINARY, *(k for v in keys.values() for k in v)])]
    found = {x.doc_id: [s.kind for s in x.spans] for x in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model=model, least_ratio=secrets.LEAST_RATIO).collect()}
    assert [w for i, w in enumerate(ORDINARY) if found[i]] == []
    at = len(ORDINARY)
    for v in keys.values():
        assert sum(found[i] == ["markov"] for i in range(at, at + len(v))) >= 0.9 * len(v)
        at += len(v)
