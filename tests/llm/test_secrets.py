import hashlib
import re
import time

import pytest

from cohortspark.llm import secrets

DOCS = "doc_id long, text string, spans string, kind int"

FOUND = [
    ('DEFAULT = "h7Gk2pQ9xZ"\nuser = "bob"\npassword = DEFAULT\n', ["h7Gk2pQ9xZ"]),
    ('secret = LATER\nLATER = "q1W2e3R4t5"\n', ["q1W2e3R4t5"]),
    ('A = "q1W2e3R4t5"\nB = A\nC = B\nself.secret = C\n', ["q1W2e3R4t5"]),
    ('A = B\nB = A\npassword = A\nB = "q1W2e3R4t5"\n', ["q1W2e3R4t5"]),
    ('{"db": {"password": "s3cr3t!Pass", "host": "db.example.org"}, "token_count": "12345678"}', ["s3cr3t!Pass"]),
    ("db:\n  user: bob\n  passphrase:\n    value: Zk93mfP0aq\nother:\n  value: Zk93mfP0aw\n", ["Zk93mfP0aq"]),
    ("export SERVICE_KEY=sk_4eC39HqLyjWDarjtT1zdp7dc\n", ["sk_4eC39HqLyjWDarjtT1zdp7dc"]),
    ('const k = "A1b2" + "C3d4e5F6";\nclient.apiKey = k || "none";\n', ["A1b2", "C3d4e5F6"]),
    ('const t = process.env.TOKEN || "q9W8e7R6t5Y4";\nlet authToken = t;', ["q9W8e7R6t5Y4"]),
    ('let signingKey: string = "f9G8h7J6k5L4m3N2";', ["f9G8h7J6k5L4m3N2"]),
    ('os.environ["DB_PASSWORD"] = "x9!kLmPq2"', ["x9!kLmPq2"]),
    ('conn.setPassword("qwe98Asd!")\nmap.put("client_secret", "abc987XYZ654")', ["qwe98Asd!", "abc987XYZ654"]),
    ('<user>bob</user><password>Tr0ub4dor&3</password>\n<add key="ApiKey" value="9f8e7d6c5b4a"/>', ["Tr0ub4dor&3", "9f8e7d6c5b4a"]),
    ('#define API_TOKEN "aZ09bY18cX27"\n', ["aZ09bY18cX27"]),
    ('secret = (\n  "abcD1"\n  "efgH2"\n)\nnext = 1', ["abcD1", "efgH2"]),
    ("'pwd' => 'zX12cV34', 'user' => 'bob12345'", ["zX12cV34"]),
]
CLEAN = [
    "The secret: patience. It's a token of love; don't pass = by. password: required for login.",
    'password = "changeme"\napi_key = "your-api-key"\nsecret = "${SECRET}"\ntoken = os.getenv("API_TOKEN")',
    'token_url = "https://a1b2c3.example.org/x9"\npassword_field = "pw12345678"\nmax_tokens = 40960000',
    'user = "h7Gk2pQ9xZ"\ncolour: "a1B2c3D4e5F6"',
    "l'école: 'secret' d'hier\nthe key: one two three",
]


@pytest.mark.parametrize("text,want", FOUND)
def test_literals_of_secret_names(text, want):
    assert [text[a:b] for a, b in secrets.literals(text)] == want


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_have_no_literals(text):
    assert secrets.literals(text) == []


def test_names():
    assert [secrets.sensitivity(n) for n in ("dbPassword", "API_KEY", "x.secret", "tokenCount", "password_file", "author", "monkey", "keyboard", "")] == [1, 1, 1, 0, 0, 0, 0, 0, 0]


def test_base_by_plain_loops():
    text = 'a PASSWORD: "x=y1234567 token=abc secret=token:abcdefghij api-key=12345678 Api_Key\'  =  "12345678" AKIAAKIA12345678 AKIA12345678901 ' + "f" * 31 + " " + "0a" * 20 + "G ſecret=12345678 toKen=12345678"
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want, at = [], 0
    while m := rule.search(text, at):
        at = m.end()
        if len(m.group(2)) >= 8:
            want.append((m.start(), m.end(), "assign"))
    for kind, letters, head, least in (("access", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 16), ("hex", "0123456789abcdef", "", 32)):
        i = 0
        while i < len(text):
            j = i + len(head)
            if text.startswith(head, i):
                while j < len(text) and text[j] in letters:
                    j += 1
            if not text.startswith(head, i) or j == i + len(head):
                i += 1
                continue
            if j - i >= least:
                want.append((i, j, kind))
            i = j
    assert sorted(secrets.base(text)) == sorted(want) and {k for _, _, k in want} == {"assign", "access", "hex"}
    assert not any(text[a:b].startswith("secret=token") for a, b, _ in want)  # a short match still uses up its text


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in secrets.digests(docs).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    assert len(got) == len(texts) and sum(r.n_assign for r in got.values()) > 5 and sum(r.n_hex for r in got.values()) > 5
    order = {k: i for i, k in enumerate(secrets.KINDS)}
    for i, text in texts.items():
        base = sorted(secrets.base(text or ""), key=lambda s: (s[0], order[s[2]]))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[2] == k for s in base) for k in secrets.KINDS[:3])
        spans = [s.split(":") for s in got[i].spans.split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= {(k, a, b) for a, b, k in base}
        assert spans == sorted(spans, key=lambda s: (int(s[1]), order[s[0]], int(s[2])))


def test_edges(spark):
    long = "word " * 100000 + 'é password = "h7Gk2pQ9xZ"'
    rows = [(1, None, "x", 1), (2, "", None, 1), (3, "clean", "x", None), (4, long, "x", 1), (4, long, "x", 1), (None, "token=12345678", "x", 1)]
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.secret_spans(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    four = (4, [("assign", 500002, 500024), ("literal", 500014, 500024)])
    assert got == sorted([(1, []), (2, []), (3, []), four, four, (None, [("assign", 0, 14)])], key=str) or got == sorted([(1, []), (2, []), (3, []), four, four, (None, [("assign", 0, 14), ("literal", 6, 14)])], key=str)
    assert secrets.digests(spark.createDataFrame([], DOCS)).count() == 0
    none = secrets.digests(spark.createDataFrame(rows[:1], DOCS)).first()
    assert none.base_sha256 == hashlib.sha256(b"").hexdigest() and none.spans == "" and none.n_hex == 0


@pytest.mark.parametrize("unit", ['token = a ', 'secret[a]=', '\\"', "token=(", 'token="a"+', "token:\n", '<a key="token" ', "<token>a", "token{", 'token """a '])
def test_linear_in_odd_texts(unit):
    took = []
    for n in (20000, 80000):
        began = time.time()
        secrets.scan("token " + unit * n)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 0.5
