"""Secret scans: high-recall candidates, a random forest removes false alarms.

From the text to the verdict everything is SQL; the forest, fitted on labelled
findings, is a sum of CASE expressions.
"""

from __future__ import annotations

import base64
import random
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import filled
from marginalia.llm.spans import flag, spans
from marginalia.llm.trees import Forest, forest

#: What a value is named, right before it.
NAMED = r"(?:passw(?:or)?d|passwd|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key)(?:[_-]?(?:key|value))?"
#: A run of 16 or more key characters, also right after NAME= (a name before = is none); a private key with its body;
#: a shorter value right after such a name and = or :; a password in a URL.
CANDIDATE = "|".join((
    r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}+(?:(?<!-----BEGIN)|(?! [A-Z ]{0,20}PRIVATE KEY-----))={0,2}(?![A-Za-z0-9+/_=-])",
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:\s*+[A-Za-z0-9+/=]++)*+(?:\s*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?+",
    rf"(?<=[=:][ \t]{{0,2}}[\x22\x27`]?)(?<=(?i:{NAMED})[\x22\x27`]?[ \t]{{0,2}}[:=]{{1,2}}[ \t]{{0,2}}[\x22\x27`]?)[^\s\x22\x27`<>,;&(){{}}\[\]:=]{{6,}}+",
    r"(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s:/@]{4,}+(?=@)"))
#: Without this there is no candidate.
NEEDED = "rlike(text, '[A-Za-z0-9+/_.-]{16}|-----BEGIN|://|(?i:pass|pwd|secret|token|credential|key)')"
THRESHOLD = 0.5
DICTIONARY = (
    "account address admin application author backup build cache change client cloud code commit common config connect content context control copy core create data database "
    "date default delete demo deploy develop directory docs document download dummy email engine error event example export feature field file filter folder format frame function "
    "group handler header home host html http https image import index info install issue item json library license line link list local login main make manager master message "
    "model module name network node number object option order package page param password path pattern placeholder policy port private process product profile program project "
    "public query read record release report request resource response result root sample schema script search section secret select server service session setting shared size "
    "source stage static status storage stream string style system table target task template temp test text time token tool type update upload user util value version view web window your"
).split()
NEAR = {
    "near_key": "token|secret|passw|passwd|pwd|auth|bearer|api.?key|access.?key|private|credential|client.?secret|signature",
    "near_hash": "sha|md5|digest|checksum|etag|commit|blob|revision|integrity|hash|fingerprint",
    "near_id": "uuid|guid|build|trace|request.?id|session.?id|serial|isbn|version|release|image|file|path|order",
    "near_mock": "example|sample|dummy|test|placeholder|changeme|your",
}


#: Words in a file's path that go with findings of either kind.
PATHS = {"path_mock": "test|spec|fixture|mock|example|sample|demo|docs?/|readme|lock", "path_config": "[.]env|config|setting|credential|secret|deploy|[.](?:ya?ml|toml|ini|properties|tf|pem)$"}


def features(c: str, path: str = "''") -> dict[str, str]:
    """Length, kinds of characters and changes between them, dictionary coverage, path and neighbouring words."""
    v, ahead = f"{c}.value", f"{c}.ahead"
    share = lambda keep: f"length(regexp_replace({v}, '[^{keep}]', '')) / length({v})"
    changes = lambda a, b: f"regexp_count({v}, '(?<=[{a}])[{b}]') / length({v})"
    out = {
        "length": f"cast(length({v}) as double)", "digits": share("0-9"), "capitals": share("A-Z"), "smalls": share("a-z"), "marks": share("+/=_.-"),
        "hex": flag(f"rlike({v}, '^[0-9a-fA-F]+$')"), "uuid": flag(f"rlike({v}, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')"),
        "distinct": f"size(array_distinct(split({v}, ''))) / length({v})",
        "small_digit": changes("a-z", "0-9"), "digit_small": changes("0-9", "a-z"), "small_capital": changes("a-z", "A-Z"), "capital_small": changes("A-Z", "a-z"),
        "capital_digit": changes("A-Z", "0-9"), "repeats": f"regexp_count({v}, '(.)(?=\\\\1)') / length({v})",
        "vowels": share("aeiouAEIOU"), "words": f"1D - length(regexp_replace(lower({v}), '{'|'.join(DICTIONARY)}', '')) / length({v})",
        "slashes": f"cast(length(regexp_replace({v}, '[^/]', '')) as double)", "dots": f"cast(length(regexp_replace({v}, '[^.]', '')) as double)",
        "prefix": flag(f"rlike({v}, '^(?:AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk-|xox[abpr]-|AIza|eyJ|-----BEGIN)')"),
        "url": flag(f"rlike({ahead}, '(?:://|www\\\\.)[^ ]*$')"), "assigned": flag(f"rlike(right({ahead}, 4), '[=:]')"), "string": flag(f"rlike(right({ahead}, 1), '[\\'\"`]')"),
    }
    out |= {"named": flag(f"rlike({ahead}, '{NAMED}[\\\\x22\\\\x27`]?[ \\\\t]*[:=]+[ \\\\t]*[\\\\x22\\\\x27`]?$')"), "userinfo": flag(f"{c}.after = '@' and rlike({ahead}, '://[^ :/@]*:$')"),
            "odd": f"length(regexp_replace({v}, '[A-Za-z0-9+/=_.-]', '')) / length({v})", "called": flag(f"{c}.after = '('")}
    out |= {k: flag(f"rlike(lower({path}), '{rx}')") for k, rx in PATHS.items()}
    return out | {k: flag(f"rlike({ahead}, '{rx}')") for k, rx in NEAR.items()}


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """Made-up lines with one finding each, 1 for a secret: keys in assignments against hashes, ids, paths, mock values."""
    r = random.Random(seed)
    of = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, small, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key() -> str:
        return r.choice([
            lambda: of(hexa, r.choice([32, 40, 64])), lambda: of(alnum, r.randint(20, 64)), lambda: "AKIA" + of(alnum[:26] + "0123456789", 16), lambda: "ghp_" + of(alnum, 36),
            lambda: "sk_live_" + of(alnum, 24), lambda: f"xoxb-{of('0123456789', 12)}-{of(alnum, 24)}", lambda: base64.b64encode(of(alnum, r.randint(18, 45)).encode()).decode(),
            lambda: f"eyJhbGciOiJIUzI1NiJ9.{of(alnum, 40)}.{of(alnum + '_-', 43)}", lambda: of(alnum + "+/", 40), lambda: of(small, 32),
            lambda: of(alnum[:52], r.randint(20, 64)), lambda: f"eyJhbGciOiJSUzI1NiJ9.{of(alnum + '_-', r.randint(200, 900))}.{of(alnum + '_-', 342)}", lambda: of(alnum + "+/", r.randint(257, 1200))])()

    def short() -> str:
        return "".join(r.choice(alnum if r.random() < 0.8 else "!@#$%^*-_+.") for _ in range(r.randint(8, 14)))

    def block(name: str, lines: int) -> str:
        return f"-----BEGIN {name}-----\n" + "\n".join(of(alnum + "+/", 64) for _ in range(lines)) + f"\n-----END {name}-----"

    def other() -> str:
        word = lambda: r.choice(DICTIONARY)
        return r.choice([
            lambda: of(hexa, r.choice([32, 40, 64])), lambda: str(uuid.UUID(int=r.getrandbits(128))), lambda: "/".join(word() for _ in range(r.randint(3, 6))) + f"/{word()}{r.randint(1, 99)}.txt",
            lambda: "-".join(word() for _ in range(r.randint(3, 6))) + f"-{r.randint(1, 2030)}", lambda: "_".join(word() for _ in range(3)) + str(r.randint(1, 99)), lambda: of("0123456789", r.randint(16, 24)),
            lambda: f"2026-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}", lambda: f"{word()}.{word()}.{word()}.v{r.randint(1, 9)}.{r.randint(0, 99)}",
            lambda: "/".join(word() for _ in range(r.randint(3, 60))), lambda: r.choice("-_.").join(word() for _ in range(r.randint(3, 8))), lambda: "".join(word() for _ in range(r.randint(3, 5))),
            lambda: "".join(w.capitalize() for w in (word(), word(), word())), lambda: r.choice("-_./") * r.randint(16, 90), lambda: of(alnum, r.randint(1, 4)) * r.randint(70, 200), lambda: of(alnum + "+/", r.randint(257, 1200)),
            lambda: f"your_{word()}_token_1234", lambda: "x" * r.randint(12, 24) + "1234", lambda: "".join(w.capitalize() for w in (word(), word(), word(), word())) + str(r.randint(1, 9))])()

    good = ['token = "{}"', "api_key={}", "password: {}", 'secret_key = "{}"', "Authorization: Bearer {}", "export ACCESS_KEY={}", "client_secret: '{}'", "aws_secret_key = {}", "auth token {} was used", 'token = "{}" and so on']
    bad = ["sha256:{}", "commit {}", "md5 digest {}", "etag: {}", "see https://host.net/{}", "request id {}", "build {}", "the file {}", "checksum {}", "order {} shipped", "image blob {}", "{}", "revision {} of it", 'path = "{}"', '{} = "none"']
    named = ["password = {}", "password: {}", 'passwd="{}"', "DB_PASSWORD={}", "pwd: '{}'", 'passphrase = "{}"', "secret={} ", "https://bob:{}@db.net/x"]
    void = ["required", "changeme", "password", "string", "optional", "********", "getpass.getpass", "os.environ", "forgotten", "process.env", "undefined", "settings.password", "xxxxxxxx", "your-password", "the same"]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.12:
            out.append((r.choice(["", "then ", "note. "]) + r.choice(named).format(short().replace("@", "!")), 1))
        elif kind < 0.2:
            out.append((r.choice(["", "then ", "note. "]) + r.choice(named[:-1]).format(r.choice([r.choice(void), r.choice(DICTIONARY) + r.choice(["", ".", "_"]) + r.choice(DICTIONARY)])), 0))
        elif kind < 0.23:
            out.append((block(r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"]), r.randint(1, 20)), 1))
        elif kind < 0.25:
            out.append((block(r.choice(["CERTIFICATE", "PUBLIC KEY"]), 2), 0))
        elif r.random() < 0.5:
            out.append((r.choice(["", "then ", "note. "]) + r.choice(good).format(key()), 1))
        elif r.random() < 0.15:  # a key's context around what is none
            mock = r.choice([f"your_{r.choice(DICTIONARY)}_token_1234", "x" * 16 + "1234", "example-token-12345", "placeholder_password_1", "test-secret-value-01"])
            out.append((r.choice(good).format(mock), 0))
        else:
            out.append((r.choice(["", "then ", "note. "]) + r.choice(bad).format(other()), 0))
    return out


@lru_cache(maxsize=4)
def _fitted(rows: tuple[tuple[float, ...], ...], marks: tuple[int, ...]) -> Forest:
    return forest(np.array(rows), np.array(marks, float))


def _pathed(findings: list[tuple], seed: int = 3) -> list[tuple[str, int, str]]:
    """Findings with a made-up path where they have none: half have an empty one, mock ones go with false alarms more often."""
    r = random.Random(seed)
    mock, real, any_ = ["tests/test_auth.py", "docs/example.md", "spec/fixtures/a.json", "package-lock.json"], [".env", "config/settings.toml", "deploy/prod.yaml", "credentials.ini"], ["src/main.py", "lib/client.js", "src3", "web"]
    return [x if len(x) == 3 else (*x, r.choice(["", "", "", *any_, *(r.choices([mock, real], [1, 3] if x[1] else [3, 1])[0])])) for x in findings]


def fit(spark: SparkSession, findings: list[tuple] | None = None) -> Forest:
    """The forest over labelled findings; features by the same SQL as a corpus's.

    A finding is a text, 1 for a secret (0 if none) for each candidate in it,
    and, where it's known, the path of its file.
    """
    frame = spark.createDataFrame(_pathed(findings or labelled_findings()), "text string, mark int, path string").coalesce(1)
    rows = frame.select("path", "mark", F.expr(f"explode({found('text')}) as c")).select(
        "mark", *[F.expr(sql).alias(k) for k, sql in features("c", "path").items()]).collect()  # about one a finding
    rows.sort()
    return _fitted(tuple(tuple(r[1:]) for r in rows), tuple(r.mark for r in rows))


def found(text: str, needs: str | None = None) -> str:
    """SQL of the candidates in a text, with 48 code points of context."""
    return spans(text, CANDIDATE, "secret", needs, back=8)


def scan(documents: DataFrame, *, findings: list[tuple] | None = None, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """One row a candidate: doc_id, start, end (code points), value_sha256, length, p, secret (p >= threshold).

    Candidates are runs of 16 or more key characters of any length, whole
    private keys, values of six or more characters right after a name such as
    password or token, and passwords in URLs; a shorter value is none. ``path``
    names a column with the text's file or place, if there is one. The value
    itself isn't returned. Null and empty texts have no candidates; a null path
    is empty; repeated rows give theirs each; an empty table gives no rows;
    other columns are left out.
    """
    model = fit(documents.sparkSession, findings)
    made = features("c", "path")
    inner = ", ".join(f"'{n}', {sql}" for n, sql in made.items())
    where = filled(F.col(f"`{path}`").cast("string")) if path else F.lit("")
    docs = documents.select("doc_id", filled(F.col("text")).alias("text"), where.alias("path"))
    some = docs.select("doc_id", "text", "path", F.expr(found("text", NEEDED)).alias("found")).where("size(found) > 0")
    rows = some.select("doc_id", F.expr(f"explode(transform(found, c -> named_struct('start', c.start, 'end', c.end, 'value', c.value, 'f', named_struct({inner})))) as c"))
    return rows.select(
        "doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.sha2(F.col("c.value"), 256).alias("value_sha256"), F.length("c.value").cast("long").alias("length"),
        F.expr(model.sql([f"c.f.{n}" for n in made])).alias("p")).withColumn("secret", F.col("p") >= threshold)
