"""Labelled findings to train the secret scanner on: strings in context, and whether they are secrets.

Made by fixed rules from a seed, so that the model can be rebuilt anywhere. Secrets are of the
common published formats and of free-form assignments; the rest are strings that look like
them: checksums, revision identifiers, UUIDs, numbers, addresses, encoded data, long words.
"""

from __future__ import annotations

import base64
import random
import string

_HEX, _B62, _B64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
_PARTS = ("an", "the", "tion", "re", "ent", "ing", "ver", "sch", "keit", "ción", "ado", "mente", "que", "eau", "elle", "ment", "or", "is", "ist", "to", "la", "der", "und", "es", "on")

#: Besides common parts of words, all pairs of a consonant or two with a vowel, either way round.
_SYLLABLES = [a + b for a in ("b", "c", "ch", "d", "f", "g", "h", "k", "l", "ll", "m", "n", "nd", "nt", "p", "pf", "qu", "r", "rr", "s", "sh", "sch", "st", "t", "th", "tr", "v", "w", "wh", "z") for b in "aeiou"]
_SYLLABLES += [s[::-1] for s in _SYLLABLES]


def _of(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choices(alphabet, k=n))


def _prose(r: random.Random, n: int) -> str:
    words = []
    for _ in range(n):
        if r.random() < 0.15:
            words.append(r.choice((_of(r, string.digits, r.randint(2, 18)), f"+{r.randrange(99)} ({_of(r, string.digits, 3)}) 555-{_of(r, string.digits, 4)}", f"{_of(r, string.ascii_lowercase, 5)}@mail{r.randrange(9)}.example.com", ".".join(_of(r, string.digits, 2) for _ in range(4)))))
        w = "".join(r.choices(_PARTS if r.random() < 0.4 else _SYLLABLES, k=r.choice((1, 1, 2, 2, 3, 4))))
        words.append((w.capitalize() if r.random() < 0.12 else w) + r.choice(("", "", "", "", ",", ".", "###", " |", "$$$", "!!", "%%%")))
    return " ".join(words)


def _assign(r: random.Random, value: str) -> str:
    name = r.choice(("token", "secret", "api_key", "apikey", "API_KEY", "password", "passwd", "auth_token", "access_token", "client_secret", "SECRET_KEY", "private_key", "credential", "db_password", "aws_secret_access_key", "Authorization"))
    return r.choice(('{} = "{}"', "{}: {}", "{}={}", '"{}": "{}"', "{} = '{}'", 'export {}="{}"', "{} {}")).format(name, value)


def _password(r: random.Random) -> str:
    """What people choose, with or without digits and signs."""
    k = r.randrange(4)
    if k == 0:
        return _of(r, string.ascii_letters, r.randint(6, 16))
    if k == 1:
        return _of(r, _B62 + "!$#&*?^%@", r.randint(6, 20))
    if k == 2:
        return "".join(r.choices(_SYLLABLES, k=r.randint(2, 4))).capitalize() + r.choice(("!", "$", "#", "&", "", "1", "99")) + r.choice(("", "x", "!"))
    return r.choice(("-", "_", ".", "")).join("".join(r.choices(_SYLLABLES, k=2)) for _ in range(r.randint(2, 5)))


def _secret(r: random.Random) -> tuple[str, str]:
    k = r.randrange(15)
    if k == 0:
        v = "AKIA" + _of(r, string.ascii_uppercase + string.digits, 16)
    elif k == 1:
        v = r.choice(("ghp_", "gho_", "ghs_", "github_pat_")) + _of(r, _B62, 36)
    elif k == 2:
        v = r.choice(("sk-", "sk_live_", "rk_live_", "pk_live_", "sk-proj-")) + _of(r, _B62, r.randint(20, 48))
    elif k == 3:
        v = f"xox{r.choice('bpas')}-{_of(r, string.digits, 12)}-{_of(r, string.digits, 12)}-{_of(r, _B62, 24)}"
    elif k == 4:
        part = lambda n: base64.urlsafe_b64encode(_of(r, _B62, n).encode()).decode().rstrip("=")
        v = "eyJhbGciOiJIUzI1NiJ9." + part(r.randint(30, 60)) + "." + _of(r, _B62 + "-_", 43)
    elif k == 5:
        v = "AIza" + _of(r, _B62 + "-_", 35)
    elif k == 6:
        v = _of(r, _B64, r.randint(64, 160))
        kind = r.choice(("RSA ", "EC ", "OPENSSH ", "")) + "PRIVATE KEY-----"
        return v, f"-----BEGIN {kind}\n{v}\n-----END {kind}"
    elif k == 7:
        v = f"{_of(r, string.ascii_lowercase, 6)}:{r.choice((_password(r), _of(r, _B62, r.randint(10, 20))))}@db.{_of(r, string.ascii_lowercase, 6)}.example"
        v = v.split(":", 1)[1]
        return v, r.choice(("postgres://", "mysql://", "mongodb://", "redis://")) + _of(r, string.ascii_lowercase, 6) + ":" + v
    elif k in (13, 14):
        v = _password(r)
        return v, _assign(r, v)
    elif k in (8, 9):
        v = _of(r, _HEX, r.choice((32, 40, 40, 48, 64)))
        return v, _assign(r, v)
    elif k in (10, 11):
        v = _of(r, r.choice((_B62, _B64, _B62 + "-_")), r.randint(16, 64))
        return v, _assign(r, v)
    else:
        v = _of(r, _B62 + "-_.=", r.randint(24, 90))
        return v, r.choice(("Bearer ", "Authorization: Bearer ", "Authorization: Basic ")) + v
    return v, v if r.random() < 0.5 else _assign(r, v)


def _harmless(r: random.Random) -> tuple[str, str]:
    k = r.randrange(18)
    if k == 0:
        v = _of(r, _HEX, r.choice((32, 40, 64)))
        return v, r.choice(("commit ", "sha256:", "md5 = ", "checksum: ", "sha1=", "revision ", "tree ", "blob ", "etag: ", "digest ")) + v
    if k == 1:
        h = _of(r, _HEX, 32)
        v = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
        return v, r.choice(("id=", "uuid ", "request-id: ", "trace ", "")) + v
    if k == 2:
        v = _of(r, string.digits, r.randint(12, 19))
        return v, r.choice(("card ", "order ", "", "isbn ", "no. ")) + v
    if k == 3:
        v = f"{_of(r, string.ascii_lowercase, r.randint(3, 9))}{r.randrange(99)}@mail{r.randrange(9)}.example.{r.choice(('com', 'org', 'net'))}"
        return v, r.choice(("", "mailto:", "contact ")) + v
    if k == 4:
        v = f"{r.choice(('www', 'm', 'blog'))}.{_of(r, string.ascii_lowercase, 8)}.example.com/{r.choice(('en', 'fr', 'p'))}/{r.randrange(9999)}/{''.join(r.choices(_PARTS[:10], k=2))}"
        return v, "https://" + v
    if k == 5:
        v = base64.b64encode(_prose(r, 12).encode()).decode()
        return v, r.choice(("data:image/png;base64,", "data:font/woff2;base64,", "content: ")) + v
    if k == 6:
        v = f"{r.randrange(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}.{r.randrange(999):03}Z"
        return v, v
    if k == 7:
        v = "-".join("".join(r.choices(_PARTS[:9], k=2)) for _ in range(4)) + f"-{r.randrange(99)}"
        return v, r.choice(("/blog/", "#", "page ", "")) + v
    if k == 8:
        v = "_".join("".join(r.choices(_PARTS[:9], k=2)) for _ in range(3)) + f"_v{r.randrange(9)}.{r.choice(('tar.gz', 'parquet', 'json', 'png'))}"
        return v, v
    if k == 9:
        v = ".".join(str(r.randrange(256)) for _ in range(4)) + r.choice((":8080/index", "/24/24/24", ":65535/abc"))
        return v, v
    if k == 10:
        v = r.choice(("your-api-key-here-123", "xxxxxxxxxxxxxxxxxxxx1", "<insert_token_1_here>", "changeme-changeme-1", "EXAMPLE_TOKEN_000000", "0000000000000000000000000000000000000000", "placeholder_value_1", "REPLACE_ME_WITH_TOKEN_1"))
        return v, _assign(r, v)
    if k == 11:
        v = "".join(r.choices(_PARTS[:9], k=r.randint(5, 9))) + str(r.randrange(9))
        return v, v
    if k == 12:
        v = f"+{r.randrange(99)}-{_of(r, string.digits, 3)}-{_of(r, string.digits, 3)}-{_of(r, string.digits, 4)}"
        return v, r.choice(("tel:", "phone ", "")) + v
    if k == 13:
        v = f"org.{_of(r, string.ascii_lowercase, 7)}.{''.join(r.choices(_PARTS[:8], k=2))}.v{r.randrange(9)}.Handler{r.randrange(99)}"
        return v, r.choice(("import ", "class ", "at ")) + v
    if k == 14:
        v = f"v{r.randrange(9)}.{r.randrange(99)}.{r.randrange(999)}-rc{r.randrange(9)}+build.{r.randrange(9999)}"
        return v, r.choice(("version ", "release ", "")) + v
    if k == 16:
        v = r.choice(("".join(r.choices(_SYLLABLES, k=r.randint(1, 5))), str(r.randrange(10**r.randint(1, 9))), "true", "none", "default"))
        name = r.choice(("name", "title", "color", "size", "mode", "host", "level", "city", "note", "status", "".join(r.choices(_SYLLABLES, k=2))))
        return v, r.choice(('{} = "{}"', "{}: {}", "{}={}", '"{}": "{}"', "{} = '{}'")).format(name, v)
    if k == 17:
        v = "".join(r.choices(_SYLLABLES, k=r.randint(5, 9)))
        return v, v
    v = "=" * r.randint(8, 30) + str(r.randrange(9)) + "-" * r.randint(8, 20)
    return v, v


def labelled(n: int, seed: int = 11) -> list[tuple[str, int, int, bool]]:
    """``(text, start, end, is_secret)``, half of them secrets; the bounds are those of the string within the text."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        value, shown = (_secret if i % 2 == 0 else _harmless)(r)
        before = _prose(r, r.randint(1, 8)) + r.choice((" ", " ", "\n", ""))
        if before and before[-1].isalnum() and shown[0].isalnum():
            before += " "
        text = before + shown + r.choice((" ", "\n", ";", '"', "")) + " " + _prose(r, r.randint(1, 5))
        at = len(before) + shown.index(value)
        out.append((text, at, at + len(value), i % 2 == 0))
    return out
