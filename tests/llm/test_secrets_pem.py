"""Private keys in PEM: no byte of the key survives the pipeline's stage."""

import base64
import random

import corpus_pipeline as pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def body(n, width=64):
    b = base64.b64encode(random.Random(n).randbytes(n)).decode()
    return [b[i : i + width] for i in range(0, len(b), width)]


def pem(label, lines, end="\n"):
    return end.join([f"-----BEGIN {label}PRIVATE KEY-----", *lines, f"-----END {label}PRIVATE KEY-----"])


def cut(text):
    return text[: text.index("-----END")].rstrip()


KEY, EC, LARGE = body(1200), body(121), body(60_000)
HEADERS = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0011", ""]
CASES = {
    "rsa": (f"é before {pem('RSA ', KEY)} after", "é before [SECRET] after"),
    "plain, crlf": (pem("", KEY, "\r\n") + "\r\nafter", "[SECRET]\r\nafter"),
    "escaped": ('{"key": "' + pem("EC ", EC, r"\n") + r'\n"}', r'{"key": "[SECRET]\n"}'),
    "encrypted": (pem("RSA ", HEADERS + KEY), "[SECRET]"),
    "quoted": (pem("RSA ", KEY, "\n> "), "[SECRET]"),
    "one line": (pem("", KEY, " "), "[SECRET]"),
    "two keys": (pem("", EC) + "\nand\n" + pem("RSA ", KEY), "[SECRET]\nand\n[SECRET]"),
    "very long": (pem("OPENSSH ", LARGE), "[SECRET]"),
    "many dashes": (pem("", ["- - -" * 20_000, *KEY]), "[SECRET]"),
    "no end": (cut(pem("RSA ", KEY)) + "\nThe text goes on.", "[SECRET]\nThe text goes on."),
    "no end, headers": (cut(pem("RSA ", HEADERS + KEY)) + "\n\nNot a key: x", "[SECRET]\n\nNot a key: x"),
    "no end, escaped": (cut(pem("EC ", EC, r"\n")), r"[SECRET]\n"),
    "no end, then a whole one": (cut(pem("RSA ", KEY)) + "\n" + pem("EC ", EC) + " x", "[SECRET]\n[SECRET] x"),
    "other end": (cut(pem("RSA ", KEY)) + "\n-----END PRIVATE KEY----- x", "[SECRET]\n-----END PRIVATE KEY----- x"),
    "header only": ("see -----BEGIN RSA PRIVATE KEY----- in the file", "see [SECRET] in the file"),
}


def test_no_key_byte_survives(spark):
    rows = [(i, text, "en", "s", len(text)) for i, (text, _) in enumerate(CASES.values())]
    got = {r.doc_id: r.text for r in pipeline.secret_scan(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert got[i] == want, name
    assert not [line for line in KEY + EC + LARGE for t in got.values() if line in t]
