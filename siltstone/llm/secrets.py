"""Problem 7: credentials in code, found by a linear-chain conditional random field.

Lines are cut into lexical tokens; shape, length, alphabet and the names around
a token are its features. Viterbi gives the tokens that are credentials, so the
exact characters are known, and only those are replaced. The field is trained on
lines made here from templates; nothing of the data goes into it.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import spread
from siltstone.sources.tables import table

#: Made lines the field is trained on, passes over them, and their seed.
TRAIN_LINES, PASSES, SEED = 20000, 3, 11
#: Spellings, kinds of lines and context scores a task remembers before it starts afresh.
KEPT = 300_000
# Parts of names that go with credentials, and with things that look alike.
SECRET_PARTS = frozenset(
    "pass passwd password passphrase passwort kennwort pwd pw pin secret token auth authorization bearer credential credentials cred apikey accesskey privatekey signing encryption hmac webhook session cookie jwt pat login key passe motdepasse contrasena clave senha dsn broker account storage shared access service api client connection".split()
)
PASSWORD_PARTS = frozenset("pass passwd password passphrase passwort kennwort pwd pw pin passe motdepasse contrasena clave senha".split())
NEUTRAL_PARTS = frozenset(
    "id uuid guid trace request digest hash checksum etag sha sha1 sha256 sha512 md5 crc integrity commit revision version build fingerprint path file dir public cert certificate pem url uri host name label data blob table image base64 color font icon nonce salt".split()
)
_TOKEN = re.compile(
    r"""-{4,}(?:BEGIN|END)\ [A-Z0-9 ]+-----
    |(?<=://)[^\s:/@"'`]*:(?!\d+(?:[\s/"'`]|$))[^\s/@"'`]+(?:@|(?=["'`]|$))
    |\$\{[^}\n]*\}|\{\{[^}\n]*\}\}|<[^<>\s]+>|\$\([^)\n]*\)
    |(?:[A-Za-z][A-Za-z0-9+.-]*)?://
    |[A-Za-z_$][\w$-]*(?=["'`\]]*\s*(?::=|=>|=|:(?!//)))
    |(?:[^\s"'`,;(){}\[\]<>\\=:]|\\(?:u\{\w+\}|\S))+(?:[=:](?!//)(?:[^\s"'`,;(){}\[\]<>\\=:]|\\(?:u\{\w+\}|\S))+)*={0,2}(?![^\s"'`,;(){}\[\]<>\\])
    |(?:[^\s"'`,;(){}\[\]<>\\=:]|\\(?:u\{\w+\}|\S))+
    |\S""",
    re.X,
)
_LOGIN = re.compile(r"[^\s:/@\"'`]*:[^\s/@\"'`]+@?")
_QUOTES = frozenset("\"'`")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def name_class(word: str) -> str:
    parts = [p.lower() for p in _PARTS.findall(word)]
    if not parts:
        return "none"
    hit_s = [p in SECRET_PARTS for p in parts]
    hit_n = [p in NEUTRAL_PARTS for p in parts]
    joined = "".join(parts)
    kind = "password" if joined in PASSWORD_PARTS or any(p in PASSWORD_PARTS for p in parts) else "secret"
    if joined in SECRET_PARTS:
        return kind
    if hit_n[-1]:
        return "neutral-after" if any(hit_s) else "neutral"
    if "public" in parts:
        return "neutral"
    if any(hit_s):
        return kind
    return "neutral" if any(hit_n) else "other"


def shape_class(v: str) -> str:
    n = len(v)
    if v.startswith("----"):
        return "pem-private" if "BEGIN" in v and "PRIVATE" in v else "pem-public"
    if v[0] in "${<%" and v[-1] in "}>%)":
        return "placeholder"
    if len(set(v.lower())) <= 2:
        return "mask"
    low = v.lower()
    if re.fullmatch(r"(?:your|my|the|some|replace|change|insert|example|dummy|fake|test|redacted|todo|xxx|placeholder|null|none|true|false|default)[\w-]*", low) and not any(c.isdigit() for c in v):
        return "filler"
    if re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", v):
        return "uuid"
    if re.match(r"(?:sha\d+|md5)[-:]", low):
        return "digest"
    if v.startswith("eyJ") and v.count(".") >= 1:
        return "jwt"
    if re.fullmatch(r"(?:\.{0,2}/|~/)[\w./@-]+", v) or re.fullmatch(r"[\w.-]+(?:/[\w.@-]+)+\.\w{1,5}", v) or re.fullmatch(r"[\w.-]+\.(?:pem|key|crt|js|ts|py|go|java|json|ya?ml|sql|md|txt|html|css|example|com|org|net|io)", low):
        return "path"
    if re.fullmatch(r"[\d.,_+-]+", v):
        return "number"
    if re.fullmatch(r"v?\d+(?:\.\d+)+[\w.-]*", low):
        return "version"
    if re.fullmatch(r"(?:0x)?[0-9a-f]+|(?:0x)?[0-9A-F]+", v) and any(c.isdigit() for c in v) and n >= 8:
        return "hex"
    digit, upper, lower = any(c.isdigit() for c in v), any(c.isupper() for c in v), any(c.islower() for c in v)
    if re.fullmatch(r"[A-Za-z]+(?:[_-][A-Za-z]+)*", v):
        return "word"
    if re.fullmatch(r"[*&@]*[A-Za-z_$][A-Za-z_$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$]+)*[?!]?", v):
        return "dotted"
    flips = sum(a.isdigit() != b.isdigit() or (a.islower() and b.isupper()) for a, b in zip(v, v[1:]))
    if re.fullmatch(r"[A-Za-z0-9+/_=.~-]+", v) and digit and (upper or lower) and n >= 10 and flips >= max(3, n // 8):
        if re.match(r"[A-Za-z]{2,8}[_.-]", v):
            return "prefixed"
        return "random"
    if re.fullmatch(r"[A-Za-z_$][\w$]*", v):
        return "ident"
    if re.search(r"[!?#%@&*~^+.-]", v) and (digit or upper) and lower and not re.search(r"[|\\]", v):
        return "pw"
    return "mixed" if digit and (lower or upper) else "sign" if n == 1 else "text"


def _after_sign(line: str) -> int:
    """Where a line begins after the sign of a diff."""
    return 1 if line[:1] in "+-" and line[:6] != "-----B" and line[:2] != "--" or line[:6] == "------" else 0


def _length(n: int) -> str:
    return "1" if n < 6 else "6" if n < 10 else "10" if n < 16 else "16" if n < 36 else "36" if n < 100 else "100" if n < 300 else "300"


_SAID = frozenset("Basic Bearer get set const var let export default private static final String string public os environ return with H curl TODO remove".split())
_SCHEMES = frozenset(("basic", "bearer", "token", "with"))


def token_class(t: str) -> tuple[str, str, str, str, str]:
    """Shape, length, kind of name, and the token itself where it is a sign, a scheme or a word that names nothing."""
    if _LOGIN.fullmatch(t) and ":" in t and t.endswith("@"):
        password = t[t.index(":") + 1 :].removesuffix("@")
        return ("mask-login" if shape_class(password) in ("placeholder", "mask", "filler") else "login", _length(len(password)), "none", "", "")
    shape = "sign" if len(t) == 1 else "url" if t.endswith("://") else shape_class(t)
    name = name_class(t) if shape in ("word", "ident", "mixed") or (len(t) > 1 and t[0].isalpha() and len(t) < 30) else "none"
    return shape, _length(len(t)), name, t if len(t) == 1 or t in _SAID else "", t.lower() if t.lower() in _SCHEMES else ""


def contexts(classes: list[tuple]) -> list[tuple]:
    """For each token of a line what its features are made of: class, names before, quotes, scheme, what follows."""
    out = []
    last, after_url, quote = "start", False, ""
    near, has = "none", "none"
    for i, (shape, size, name, said, scheme_word) in enumerate(classes):
        if after_url and shape not in ("login", "mask-login"):
            shape, name = "path", "none"
        before = classes[i - 1] if i else ("", "", "", "^", "")
        nxt = classes[i + 1][3] if i + 1 < len(classes) else "$"
        opened = before[3] in _QUOTES or (i > 1 and classes[i - 2][3] in _QUOTES and before[3] in ("Basic", "Bearer"))
        quoted = "q" if opened and quote else "i" if quote else "b"
        scheme = before[4]
        following = next((c[2] for c in classes[i + 1 : i + 5] if c[2] in ("password", "secret", "neutral", "neutral-after")), "none") if last == "with" else "-"
        lead = (classes[i - 2][3] if i > 1 else "^") if opened else "-"
        out.append((shape, size, near, has, quoted, scheme, following, nxt if len(nxt) == 1 else "w", lead, name))
        if name != "none" and not said and shape in ("word", "ident", "mixed", "pw", "text") and scheme in ("", "with"):
            near = name
            rank = ("none", "neutral", "secret", "password")
            has = max(has, {"neutral-after": "neutral", "other": "none"}.get(name, name), key=rank.index)
        if said in _QUOTES:
            quote = "" if quote == said else quote or said
        after_url = shape in ("url", "login", "mask-login") and said not in _QUOTES
        last = "with" if scheme_word == "with" else last if said in _QUOTES else ""
    return out


def features(c: tuple) -> list[str]:
    shape, size, near, has, quoted, scheme, following, nxt, lead, own = c
    return [
        f"s={shape}", f"s={shape}|len={size}", f"s={shape}|near={near}", f"s={shape}|line={has}", f"s={shape}|q={quoted}", f"s={shape}|line={has}|q={quoted}|len={size}",
        f"s={shape}|near={near}|q={quoted}", f"prev={scheme}|s={shape}", f"near={near}|len={size}", f"follow={following}|s={shape}", f"next={nxt}|s={shape}",
        f"lead={lead}|s={shape}", f"own={own}|s={shape}|q={quoted}",
    ]


def _both(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class Field:
    """A linear chain of two labels, 0 other and 1 credential; scores are those of label 1 over 0."""

    def __init__(self, w: dict[str, float] | None = None, t: tuple = ((0.0, 0.0), (0.0, 0.0))) -> None:
        self.w, self.t = w or {}, t
        self.known: dict[tuple, float] = {}

    def score(self, c: tuple) -> float:
        s = self.known.get(c)
        if s is None:
            if len(self.known) > KEPT:
                self.known.clear()
            s = self.known[c] = sum(self.w.get(x, 0.0) for x in features(c))
        return s

    def viterbi(self, line: list[tuple]) -> list[int]:
        (t00, t01), (t10, t11) = self.t
        a, b = 0.0, self.score(line[0])
        back = []
        for c in line[1:]:
            a0, b0, a1, b1 = a + t00, b + t10, a + t01, b + t11
            back.append((0 if a0 >= b0 else 1, 0 if a1 >= b1 else 1))
            a, b = max(a0, b0), max(a1, b1) + self.score(c)
        path = [0 if a >= b else 1]
        for k in reversed(back):
            path.append(k[path[-1]])
        return path[::-1]

    def train(self, data: list[tuple[list[tuple], list[int]]], passes: int, rate: float = 0.3, decay: float = 1e-5) -> None:
        """Gradient of the conditional log-likelihood, line by line, with steps that adapt per weight."""
        rng = random.Random(SEED)
        sums: dict[str, float] = {}
        tsum, of = [1e-2] * 4, {}
        data = [([of.setdefault(c, features(c)) for c in line], labels) for line, labels in data]
        for _ in range(passes):
            rng.shuffle(data)
            for feats, labels in data:
                n = len(feats)
                s = [sum(self.w.get(x, 0.0) for x in f) for f in feats]
                (t00, t01), (t10, t11) = self.t
                fwd, bwd = [(0.0, s[0])], [(0.0, 0.0)]
                for y in s[1:]:
                    a, b = fwd[-1]
                    fwd.append((_both(a + t00, b + t10), _both(a + t01, b + t11) + y))
                for y in reversed(s[1:]):
                    a, b = bwd[-1]
                    bwd.append((_both(t00 + a, t01 + y + b), _both(t10 + a, t11 + y + b)))
                bwd.reverse()
                z = _both(*fwd[-1])
                grad = [0.0, 0.0, 0.0, 0.0]
                for i in range(n):
                    g = labels[i] - math.exp(min(0.0, fwd[i][1] + bwd[i][1] - z))
                    if i:
                        a, b = fwd[i - 1]
                        x, y = bwd[i][0] - z, s[i] + bwd[i][1] - z
                        for k, v in enumerate((a + t00 + x, a + t01 + y, b + t10 + x, b + t11 + y)):
                            grad[k] -= math.exp(min(0.0, v))
                        grad[2 * labels[i - 1] + labels[i]] += 1
                    if abs(g) > 1e-3:
                        for x in feats[i]:
                            q = sums[x] = sums.get(x, 1e-2) + g * g
                            self.w[x] = self.w.get(x, 0.0) * (1 - decay) + rate * g / math.sqrt(q)
                tsum = [q + g * g for q, g in zip(tsum, grad)]
                step = [t + rate * g / math.sqrt(q) for t, g, q in zip((t00, t01, t10, t11), grad, tsum)]
                self.t = ((step[0], step[1]), (step[2], step[3]))


# -- made lines ---------------------------------------------------------------

# Words of the made lines.
_NOUNS = "river stone maple harbor cloud ember falcon garden copper winter summer orange silver meadow anchor bridge castle desert forest island jungle lemon marble nickel ocean pepper quartz rocket saddle timber velvet walnut yellow zephyr butter cactus dragon engine flower guitar hammer".split()
_SECRET_NAMES = "password passwd db_password smtp_pwd admin_pass root_pw passphrase mot_de_passe passwort token api_key access_token auth_token service_token pat secret client_secret secret_key signing_secret webhook_secret shared_secret hmac_key encryption_key storage_key account_key session bearer id_token auth authorization X-Auth private_key jwt_secret login_token credential".split()
_PASSWORD_NAMES = [n for n in _SECRET_NAMES if name_class(n) == "password"]
_TOKEN_NAMES = [n for n in _SECRET_NAMES if name_class(n) != "password"]
_URL_NAMES = "database_url dsn broker cache_url redis_url amqp queue_url connection upstream mongo_uri".split()
_OPAQUE_NAMES = "client upstream remote gateway handle value conn".split()
_PLAIN_NAMES = "trace_id request_id uuid digest checksum etag sha256 integrity commit revision build_id fingerprint image_tag public_key_id cache_hash content_hash md5 data blob table asset bundle label".split()


def _pick(rng: random.Random, chars: str, n: int) -> str:
    return "".join(rng.choice(chars) for _ in range(n))


def _camel(name: str) -> str:
    a, *rest = name.split("_")
    return a + "".join(x.capitalize() for x in rest)


def _leet(rng: random.Random, w: str) -> str:
    return w.replace(rng.choice("aeio"), rng.choice("4310"), 1) if rng.random() < 0.3 else w


def _password(rng: random.Random) -> str:
    a, b = rng.choice(_NOUNS), rng.choice(_NOUNS)
    tail = str(rng.randrange(10, 9999)) if rng.random() < 0.9 else ""
    if rng.random() < 0.06:
        tail = rng.choice(["\\t", '\\"', "\\u0041", "\\x41", "\\\\"]) + tail + rng.choice(["", "\\n"])
    return _leet(rng, a).capitalize() + rng.choice(["", ".", "-", "_", "!", "%", "#", "@", "+"]) + _leet(rng, b) + tail + rng.choice(["", "", "!", "?", "#", "$"])


def _secret(rng: random.Random) -> tuple[str, str]:
    """A value and the kind of name it goes with."""
    k = rng.random()
    alnum = string.ascii_letters + string.digits
    if k < 0.06:
        w, v = rng.choice(_NOUNS), rng.choice(_NOUNS)
        return rng.choice([w, w + v, f"{w}{rng.randrange(999)}", f"{w} {v} {rng.choice(_NOUNS)}", _pick(rng, string.ascii_lowercase, rng.randrange(6, 14)), str(rng.randrange(10**5, 10**9)), f"{w}-{v}"]), "plain-password"
    if k < 0.2:
        return _password(rng), "secret"
    if k < 0.35:
        return _pick(rng, "0123456789abcdef", rng.choice([16, 20, 24, 32, 40, 48, 64])), "secret"
    if k < 0.65:
        head = _pick(rng, string.ascii_lowercase, rng.randrange(2, 6)) + rng.choice("_-.") + (rng.choice(["sk", "pat", "live", "prod", "test", "key"]) + rng.choice("_-") if rng.random() < 0.5 else "")
        return head + _pick(rng, alnum, rng.randrange(6, 40)), rng.choice(["secret", "opaque"])
    if k < 0.75:
        return _pick(rng, string.ascii_uppercase, 3) + _pick(rng, alnum, rng.randrange(20, 44)), rng.choice(["secret", "opaque"])
    if k < 0.85:
        return _pick(rng, alnum + "+/", 43) + "=", "secret"
    if k < 0.93:
        return "eyJ" + _pick(rng, alnum, 17) + "." + "eyJ" + _pick(rng, alnum, rng.randrange(20, 60)) + "." + _pick(rng, alnum + "_-", 43), rng.choice(["secret", "opaque"])
    return rng.choice(["Basic ", "Bearer "]) + _pick(rng, alnum, rng.randrange(16, 40)) + rng.choice(["", "=", "=="]), "secret"


def _harmless(rng: random.Random) -> tuple[str, str]:
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    k = rng.random()
    if k < 0.12:
        u = _pick(rng, hexes, 32)
        return f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", rng.choice(["plain", "opaque", "secret"])
    if k < 0.3:
        return _pick(rng, hexes, rng.choice([7, 8, 12, 32, 40, 64])), rng.choice(["plain", "plain", "opaque"])
    if k < 0.38:
        return rng.choice(["sha512-", "sha256-", "sha256:", "sha1-"]) + _pick(rng, alnum + "+/", rng.choice([43, 86])) + rng.choice(["=", "=="]), rng.choice(["plain", "secret", "opaque"])
    if k < 0.44:
        return _pick(rng, alnum + "+/", rng.randrange(300, 900)), rng.choice(["plain", "opaque"])
    w, v = rng.choice(_NOUNS), rng.choice(_NOUNS)
    name = rng.choice(_SECRET_NAMES).replace("-", "_")
    if k < 0.6:  # words are no keys; a password may be one
        return rng.choice([f"{w} {v}", w, f"{w}_{v}", f"{w}-{v}", f"{w}{rng.randrange(99)}", f"{w} {v} {rng.choice(_NOUNS)}", str(rng.randrange(10**6)), _camel(f"{w}_{v}")]), rng.choice(["token", "token", "plain", "opaque"])
    return rng.choice([
        f"${{{name.upper()}}}", f"{{{{ vault.{name} }}}}", f"<your-{name}-here>", f"<{name}>", "REPLACE_ME", "CHANGEME", "changeme", "x" * rng.randrange(6, 24), "*" * rng.randrange(6, 12),
        f"/etc/{w}/{v}.pem", f"/var/{w}/{v}.key", f"./{w}/{v}.json", f"{w}/{v}.ts", f"https://{w}.example/{v}", f"{w}.example", f"1.{rng.randrange(20)}.{rng.randrange(30)}",
        f"{w}{v}.{_pick(rng, hexes, 8)}.js", f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", "null", "dummy-" + w, f"process.env.{name.upper()}", "", f"env:{name.upper()}",
    ]), rng.choice(["secret", "plain", "opaque"])


def _name(rng: random.Random) -> str:
    name = "_".join(rng.sample(_NOUNS, rng.choice([1, 1, 2, 2, 3])))
    if rng.random() < 0.15:
        name = rng.choice(_PASSWORD_NAMES + _TOKEN_NAMES + _PLAIN_NAMES).replace("-", "_") if rng.random() < 0.4 else rng.choice([name + "_" + rng.choice(["token", "key", "session", "access", "client", "data", "id"]), rng.choice(["shared", "account", "broker", "access", "service", "storage"]) + "_" + name, name + "_broker"])
    name += rng.choice(["", "", "", "", str(rng.randrange(40)), f"_{rng.randrange(9)}"])
    camel = _camel(name)
    return rng.choice([name, name, camel, camel, camel[:1].upper() + camel[1:], name.upper()])


def _expression(rng: random.Random, depth: int = 2) -> str:
    k = rng.random()
    if depth and k < 0.45:
        a, b = _expression(rng, depth - 1), _expression(rng, depth - 1)
        return rng.choice([f"{a} + {b}", f"{a} * {b}", f"{_name(rng)}({a}, {b})", f"{_name(rng)}.{_name(rng)}({a})", f"{_name(rng)}[{a}]", f"{a} == {b}", f"[{a}, {b}]", f"{{{_name(rng)}: {a}}}", f"{_name(rng)}.{_name(rng)}", f"({a} || {b})"])
    if rng.random() < 0.12:
        return '"' + rng.choice("shared token broker session account key access service storage client signing".split()) + " " + " ".join(rng.sample(_NOUNS, rng.randrange(1, 3))) + '"'
    if rng.random() < 0.08:
        return '"' + rng.choice([" ", "", ": ", "%s "]).join(rng.sample(_NOUNS, rng.randrange(1, 4))) + rng.choice(["\\n", "\\t", "\\r\\n", "\\x1b[0m", "\\u00e9"]) + '"'
    words = " ".join(rng.sample(_NOUNS + "shared token broker session account key access service storage client signing".split(), rng.randrange(1, 5)))
    return rng.choice([_name(rng), _name(rng), str(rng.randrange(1000)), f'"{words}"', f"'{words}'", f"{rng.randrange(99)}.{rng.randrange(99)}", hex(rng.randrange(1 << 30)), f'"{rng.choice(_NOUNS)}"'])


def code_line(rng: random.Random) -> str:
    """A line of ordinary code or prose, in which nothing is a credential."""
    a, b, x, y = _name(rng), _name(rng), _expression(rng), _expression(rng, 1)
    words = " ".join(rng.choice(_NOUNS + "the a is when we it once per even for of to and not only every read written kept before after".split()) for _ in range(rng.randrange(3, 12)))
    k, secret = rng.random(), rng.choice(_SECRET_NAMES).replace("-", "_")
    data = _pick(rng, string.ascii_letters + string.digits + "+/", rng.choice([44, 60, 64, 76, 120]))
    if k < 0.05:
        return rng.choice([data, f" {data}", data[: rng.randrange(4, 40)] + rng.choice(["=", "=="]), f'"{data}"', f'"{data}" +', f"    {data}", f"{data[:20]} {data[20:]}"])
    if k < 0.1:  # where a credential is looked up
        up = secret.upper()
        return rng.choice([f'{secret} = os.environ["{up}"]', f"{secret} = os.environ['{up}']", f'{up} = os.environ.get("{up}", "{rng.choice(["********", "x" * 12, "changeme"])}")', f"const {_camel(secret)} = process.env.{up};", f'{_camel(secret)} := os.Getenv("{up}")', f'String {_camel(secret)} = System.getenv("{up}");', f'{secret}: ${{{up}}}', f'{secret} = config["{secret}"]', f'{secret} = vault.read("{a}/{secret}")', f'{secret} = settings.{secret}', f"{secret} = {a}", f"{_camel(secret)} := {a}", f"{secret} = {a};", f"{secret}({a})", f"{secret}, {a} = {b}", f'{secret}: !vault {a}'])
    if 0.14 < k < 0.18:
        return rng.choice([f'{secret} = "<your-{secret}-here>"', f"{secret}: '<{secret}>'", f'config.set("{secret}", "<your-{secret}-here>");', f'{secret} = "REPLACE_ME"', f"Then log in with `<your-{secret}-here>`."])
    if 0.18 < k < 0.2:
        one = lambda: rng.choice(string.ascii_letters)
        return ";".join(f"function {one()}{one()}({one()},{one()}){{var {one()}={one()}.{rng.choice(_NOUNS)}({one()});if({one()}>{rng.randrange(99)}){{return {one()}.{one()}(\"{rng.choice(_NOUNS)}\")}}return {one()}+{rng.randrange(9)}}}" for _ in range(rng.randrange(1, 5)))
    if k < 0.14:
        lib, v = "-".join(rng.sample(_NOUNS, rng.choice([1, 2]))), f"{rng.choice(['', 'v'])}{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}"
        return rng.choice([f"// {lib} {v} | {rng.choice(['MIT', 'Apache-2.0', 'ISC', 'BSD-3-Clause'])} licensed | upstream: {lib}.example", f"/*! {lib} {v} (c) the {lib} contributors, {rng.choice(['MIT', 'Apache-2.0'])} */", f"# {lib} {v}, copyright {rng.randrange(1990, 2030)} by its authors", f'"{lib}": "^{v}",', f"{lib}=={v}", f"# from {lib}@{v} ({words})"])
    return rng.choice([
        f"{a} = {x}", f"{a} = {x};", f"const {a} = {x};", f"{a} := {x}", f"var {a} = {x}", f"return {x}", f"return {x};", f"if {x}:", f"if ({x}) {{", f"for {a} in {b}({x}):", f"for _, {a} := range {b} {{", f"{a}({x})", f"{a}.{b}({x}, {y});", f"def {a}({b}, other):", f"def {a}(self):", f"class {a}({b}):",
        f"func {a}({b} string) error {{", f"func (x *{a}) {b}() int32 {{", f"export function {a}({b}, w) {{", f"public int {a}() {{ return f{rng.randrange(9)}_; }}", f"private {a} {b}({a} x) {{", f"import {a}", f"from {a} import {b}", f"import {{ {a} }} from \"./{rng.choice(_NOUNS)}_{rng.choice(_NOUNS)}\";", f"{a}: {y}", f"{a}: {words}", f"\"{a}\": {y},", f"- {words}", f"SELECT {a}, {b} FROM {a} WHERE {b} > {rng.randrange(99)};", f"    {a},", f"{a} TEXT NOT NULL,",
        f"# {words}", f"// {words}.", f"* {words}", f"{words}.", f"## {words}", f"-- {words}", f"{a} += {x};", f"{a} : {b} = {y}", f"log.info(\"{words}\", {a});", f"raise {a}(\"{words}\")", f"{a}_{rng.randrange(99)} = {rng.randrange(10**6)}  # {b}", f"[{rng.randrange(99)}.{rng.randrange(10**5)},{rng.randrange(99)}.{rng.randrange(10**5)},{rng.randrange(99)}.{rng.randrange(10**5)}],",
        f"INSERT INTO {a} VALUES ({rng.randrange(99)}, '{b}', {rng.randrange(10**6)});", f"!function(e,t){{var {a}=e.{b}(t);if(t>{rng.randrange(99)}){{return t.s(\"{rng.choice(_NOUNS)}\")}}}};", f"@@ -{rng.randrange(99)},{rng.randrange(9)} +{rng.randrange(99)},{rng.randrange(9)} @@", f"assert {x}", f"version: {rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(9)}", f"digest: {_pick(rng, '0123456789abcdef', 40)}", f"\"integrity\": \"sha512-{_pick(rng, string.ascii_letters + string.digits + '+/', 86)}==\",", f"    \"{_pick(rng, string.ascii_letters + string.digits + '+/', rng.choice([60, 76, 120]))}\"",
        f"b'\\n\\x{rng.randrange(10, 40)}{a}\\x12\\x1d{b}\\x1a{_pick(rng, '0123456789abcdef', 80)}'", f"0x{_pick(rng, '0123456789abcdef', 4)}, 0x{_pick(rng, '0123456789abcdef', 4)}, 0x{_pick(rng, '0123456789abcdef', 4)},", f"https://{rng.choice(_NOUNS)}.example/{rng.choice(_NOUNS)}/{a}", f"| {words} | {a} |", f"`{a}` {words}", "}", "});", f"  id: {rng.randrange(999)}",
    ])


def made_lines(n: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """``(line, credential spans)``, half of them without any."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        mark = "\x01"
        r = rng.random()
        if r < 0.06:
            kind = rng.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "PUBLIC KEY", "CERTIFICATE"])
            pem = f"-----BEGIN {kind}-----"
            value = mark + pem + mark if "PRIVATE" in kind else pem
            if rng.random() < 0.4:
                body = "\\n".join(_pick(rng, string.ascii_letters + string.digits + "+/", rng.choice([24, 48, 64])) for _ in range(rng.randrange(1, 4)))
                value = value.removesuffix(mark) + f"\\n{body}\\n" + (mark if "PRIVATE" in kind else "") + f"-----END {kind}-----" + rng.choice(["", "\\n"])
            names = _SECRET_NAMES + _PLAIN_NAMES + ["signer", "verify_with", "signing_key"]
        elif r < 0.14:
            scheme = rng.choice(["postgres", "mysql", "redis", "amqp", "https", "mongodb"])
            secret = rng.random() < 0.75
            pw = _password(rng) if secret else rng.choice(["${DB_PASS}", "xxxxxxxx", "********", "{{ vault.pw }}".replace(" ", "")])
            login = f"{rng.choice(_NOUNS)}:{mark + pw + mark if secret else pw}@"
            tail = f"db.{rng.choice(_NOUNS)}.example:{rng.randrange(1000, 9000)}/{rng.choice(_NOUNS)}"
            value = f"{scheme}://{login}" + (tail if rng.random() < 0.85 else "")
            if rng.random() < 0.1:
                value = f"{scheme}://{tail}"
            names = _URL_NAMES + ["X-Auth"]
            kind = "url"
        elif r < 0.5:
            v, kind = _secret(rng)
            if rng.random() < 0.12 and len(v) > 14 and " " not in v:
                v = v[: rng.randrange(9, len(v))]
            head, _, rest = ("", "", v) if kind == "plain-password" else v.rpartition(" ")
            value = (head + " " if head else "") + mark + rest + mark
            names = {"secret": _SECRET_NAMES, "plain-password": _PASSWORD_NAMES}.get(kind, _OPAQUE_NAMES + _SECRET_NAMES)
        else:
            value, kind = _harmless(rng)
            names = {"secret": _SECRET_NAMES, "token": _TOKEN_NAMES, "plain": _PLAIN_NAMES, "opaque": _OPAQUE_NAMES}[kind]
        name = rng.choice(names)
        name = rng.choice([name, name, name.upper(), _camel(name), _camel(name)[:1].upper() + _camel(name)[1:]])
        q = rng.choice("\"\"\"'`")
        words = " ".join(_PARTS.findall(name)).lower()
        part_of = value
        if mark in value and "BEGIN" not in value and len(value) > 14:
            part_of = value[: rng.randrange(max(9, value.index(mark) + 8), len(value))] + mark
        bare = " " not in value and value and "-----" not in value
        line = rng.choice([f"{name} = {q}{value}{q}", f"const {name} = {q}{value}{q};", f"  \"{name}\": \"{value}\",", f"{name}: {q}{value}{q}", f"settings[\"{name}\"] = \"{value}\"", f"client = connect({name}={q}{value}{q})", f"String {name} = \"{value}\";"]) if kind == "plain-password" else rng.choice([
            f"{name} = {q}{value}{q}", f"const {name} = {q}{value}{q};", f"export const {name} = {q}{value}{q};", f"var {name} = {q}{value}{q}", f"{name} := {q}{value}{q}",
            f"private static final String {name} = \"{value}\";", f"  \"{name}\": \"{value}\",", f"{name}: {q}{value}{q}", f"{name}: {value}" if bare else f"{name}: \"{value}\"",
            f"settings[\"{name}\"] = \"{value}\"", f"config.set(\"{name}\", \"{value}\");", f"client = connect({name}={q}{value}{q})", f"{name} = os.environ.get(\"{name.upper()}\", \"{value}\")",
            f"export {name}='{value}'", f"{name}={value}" if bare else f"{name}='{value}'", f"const opts_{name} = {{ {name}: `{value}` }};", f"{name} = (\"{value}\"", f"const {name} = \"{value}\" +",
            f"# TODO remove {name}: {value}", f"// TODO remove {name}: {value}", f"// curl -H 'X-Auth: {value}' https://api.{rng.choice(_NOUNS)}.example/v1", f"# curl -H 'Authorization: {value}' https://{rng.choice(_NOUNS)}.example/v1",
            f"Then log in with `{value}` as {name.replace('_', ' ').lower()}.", f"-- {name}: {value}", f"curl -u {rng.choice(_NOUNS)}:{value} https://x.example" if bare else f"login({q}{value}{q})",
        ])
        if mark not in value and kind in ("plain", "opaque", "token") and re.search(r"X-Auth|Authorization|log in|curl -u|login\(", line):
            continue  # what is sent to log in is one
        if "BEGIN" in value and rng.random() < 0.4:
            line = rng.choice(["", "  ", "    "]) + value
        if rng.random() < 0.4:
            line = code_line(rng)
        elif rng.random() < 0.1:
            a, b, c = (rng.choice(_NOUNS) for _ in range(3))
            p = rng.choice(_PASSWORD_NAMES)
            line = rng.choice([f"# the {p} is read before the {a} can {b} it", f"// {p}: {a} is kept in the {b}", f"if {p} == {a}_{b}:", f"    return check_{p}({a}, {b}.{p})", f"{p} = {a}.{b}", f"{p}: {a}", f"{p} = read_{a}(\"{b}_{c}\")", f"func {_camel(p)}({a} string, {b} int) error {{", f"raise ValueError(\"{p} {a} is {b}\")", f"| {p} | {a} {b} | {c} |", f"Use this to {a} every {b} {p}."] if rng.random() < 0.3 else [f"    {a}_{b}.{c}_token({a}{b.capitalize()}{rng.randrange(9)}, \"{c} token\")", f"const {a}Token = {b}.{c}(\"{a} {b}\") * {rng.randrange(99)};", f"export const {a}{b.capitalize()}{rng.randrange(300)} = {rng.randrange(300)};", f"import {{ {a}{b.capitalize()} }} from \"./{b}_{c}\";", f"{a}_key_{rng.randrange(9)}: {b} {c}", f"  return {a}.get(\"{b}_{c}_{rng.randrange(90)}\")"])
        line = rng.choice(["", "", "", "+", "-", " ", "    ", "+    "]) + line
        spans, text = [], ""
        for k, part in enumerate(line.split(mark)):
            if k % 2:
                spans.append((len(text), len(text) + len(part)))
            text += part
        out.append((text, spans))
    return out


_FIELD: list[Field] = []


def trained_field() -> Field:
    """The field, trained once per process."""
    if not _FIELD:
        data = []
        for line, spans in made_lines(TRAIN_LINES):
            tokens = list(_TOKEN.finditer(line, _after_sign(line)))
            if tokens:
                labels = [int(any(m.start() < b and m.end() > a for a, b in spans)) for m in tokens]
                data.append((contexts([token_class(m.group()) for m in tokens]), labels))
        field = Field()
        field.train(data, PASSES)
        _FIELD.append(field)
    return _FIELD[0]


# -- whole texts --------------------------------------------------------------

_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_BODY = re.compile(r"[+\- ]?[\s\"'`+]*(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{1,80}={0,2}|[A-Z][\w-]+: .*|)(?:\\n)?[\s\"'`,;+.\\]*$")
_SPLIT = re.compile(r"[\"'`][ \t]*[+\\.]?[ \t\r]*\n[+\- ]?[ \t]*(?:\+[ \t]*)?[\"'`]")
_OPENS = re.compile(r"[\"'`]\s*[+\\.]?\s*$")
_STRING_FIRST = re.compile(r"^[+\- ]?\s*(?:\+\s*)?[\"'`]")
#: What stays of a credential: escapes, and all that is no letter or digit.
_PIECE = re.compile(r"\\(?:u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|N\{[^}]*\}|.)|[^\W_]")


def _masked(piece: str) -> str:
    return _PIECE.sub(lambda m: m.group() if len(m.group()) > 1 else "x", piece)


class Finder:
    """Decodes every line whole; lines of the same kinds of tokens are decoded once."""

    def __init__(self, weights: Field):
        self.field = weights
        self.classes: list[tuple] = []
        self.ids: dict[str, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.decoded: dict[tuple, tuple[int, ...]] = {}

    def _learn(self, tokens: list[str]) -> None:
        if len(self.ids) > KEPT:
            self.ids.clear()
        for t in tokens:
            if t not in self.ids:
                c = token_class(t)
                n = self.numbers.get(c)
                if n is None:
                    n = self.numbers[c] = len(self.classes)
                    self.classes.append(c)
                self.ids[t] = n

    def spans(self, line: str) -> list[tuple[int, int]]:
        """Credential characters of one line."""
        at = _after_sign(line)
        tokens = _TOKEN.findall(line, at) if at else _TOKEN.findall(line)
        try:
            key = tuple([self.ids[t] for t in tokens])
        except KeyError:
            self._learn(tokens)
            key = tuple([self.ids[t] for t in tokens])
        if not key:
            return []
        hits = self.decoded.get(key)
        if hits is None:
            labels = self.field.viterbi(contexts([self.classes[n] for n in key]))
            hits = tuple(i for i, x in enumerate(labels) if x)
            if len(self.decoded) > KEPT:
                self.decoded.clear()
            if len(key) < 200:
                self.decoded[key] = hits
        if not hits:
            return []
        out: list[tuple[int, int]] = []
        places = list(_TOKEN.finditer(line, at))
        for i in hits:
            s, e = places[i].span()
            if self.classes[key[i]][0] == "login":
                s, e = line.index(":", s) + 1, e - (line[e - 1] == "@")
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], e)
            else:
                out.append((s, e))
        return out

    def find(self, text: str) -> list[tuple[int, int, int, bool]]:
        """``(line number, start, end, begins)`` over the whole text; ``begins`` is False for a credential's further lines and parts."""
        out: list[tuple[int, int, int, bool]] = []
        lines = text.split("\n")
        starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
        pem, split = "-----BEGIN " in text, _SPLIT.search(text) is not None
        block, skip = "", 0
        for no, line in enumerate(lines, 1):
            if skip:
                skip -= 1
                continue
            start = starts[no - 1]
            if block:
                end = _END.search(line)
                if end or _BODY.match(line):
                    body = line[: end.start()] if end else line
                    inner = body.strip(" +-\"'`,;\\\t\r")
                    if block == "private" and inner:
                        s = start + body.index(inner)
                        out.append((no, s, s + len(inner), False))
                    if end:
                        block = ""
                    continue
                block = ""
            m = _BEGIN.search(line) if pem else None
            joined, pieces = line, [(0, no, start)]
            if split and not m:
                # a literal that goes on in the next line's is one literal
                parts, depth, last, size = [line], line.count("(") - line.count(")"), line, 0
                while (end := _OPENS.search(last)) and no + skip < len(lines):
                    nxt = lines[no + skip]
                    go_on = _STRING_FIRST.match(nxt)
                    if not go_on or not (end.group().strip()[1:].strip() or depth > 0) or (nxt[:1] in "+-") != (line[:1] in "+-"):
                        break
                    parts[-1] = parts[-1][: end.start()]
                    size += len(parts[-1])
                    last = nxt[go_on.end() :]
                    pieces.append((size, no + skip + 1, starts[no + skip] + go_on.end()))
                    parts.append(last)
                    depth += last.count("(") - last.count(")")
                    skip += 1
                joined = "".join(parts)
            found = self.spans(joined)
            closing = _END.search(line, m.end()) if m else None
            for s, e in found:
                if m and m.start() <= s < m.end():
                    out.append((no, start + m.start(), start + m.end(), True))
                    continue
                if m and m.end() <= s < (closing.end() if closing else len(joined)):
                    continue  # the body goes with its head
                first = True
                for k, (at, at_no, place) in enumerate(pieces):
                    stop = pieces[k + 1][0] if k + 1 < len(pieces) else len(joined)
                    a, b = max(s, at), min(e, stop)
                    if a < b:
                        out.append((at_no, place + a - at, place + b - at, first))
                        first = False
            if m:
                private = "PRIVATE" in m.group() and any(m.start() <= s < m.end() for s, _ in found)
                if private and (body := line[m.end() : closing.start() if closing else len(line)]).strip():
                    out.append((no, start + m.end(), start + m.end() + len(body), False))
                if not closing:
                    block = "private" if private else "public"
        return sorted(out)

    def redact(self, text: str) -> str:
        """The text with every letter and digit of a credential replaced by ``x``; escapes and the marks around a key stay."""
        out, at = [], 0
        for _, s, e, _ in self.find(text):
            if text.startswith("-----BEGIN ", s):
                continue
            out.append(text[at:s])
            out.append(_masked(text[s:e]))
            at = e
        out.append(text[at:])
        return "".join(out)


def credential_texts(chunks: DataFrame, changed_files: DataFrame, review_jobs: DataFrame) -> DataFrame:
    """``src, row_id, path, text`` of every text that may hold credentials."""
    heads = review_jobs.select(F.col("delivery_id").alias("row_id"), F.explode("head_files").alias("path", "text"))
    return (
        chunks.select(F.lit("chunks").alias("src"), F.col("chunk_id").alias("row_id"), "path", "text")
        .unionByName(changed_files.select(F.lit("changed_files").alias("src"), F.col("change_id").alias("row_id"), "path", F.col("patch").alias("text")))
        .unionByName(heads.select(F.lit("review_jobs").alias("src"), "row_id", "path", "text"))
    )


def find_credentials(texts: DataFrame) -> DataFrame:
    """``src, row_id, path, line_no, start, stop, begins`` of each credential in ``texts`` (src, row_id, path, text).

    ``start`` and ``stop`` count characters of the whole text. NULL and empty
    texts hold none; repeated rows give repeated results. Map-only. The field's
    weights, some thousand numbers whatever the data, travel with the task.
    """
    field = trained_field()
    shared = texts.sparkSession.sparkContext.broadcast((field.w, field.t))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Field(*shared.value))
        for batch in batches:
            at, cols = [], ([], [], [], [])
            for i, text in enumerate(batch.column(3).to_pylist()):
                for row in finder.find(text):
                    at.append(i)
                    for c, v in zip(cols, row):
                        c.append(v)
            keys = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(keys.column(k) for k in range(3)), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())],
                names=["src", "row_id", "path", "line_no", "start", "stop", "begins"],
            )

    rows = spread(texts.where(F.length("text") > 0).select("src", "row_id", "path", "text"))
    return rows.mapInArrow(work, "src string, row_id long, path string, line_no long, start long, stop long, begins boolean")


def redact_credentials(texts: DataFrame) -> DataFrame:
    """``src, row_id, path, text`` with credentials replaced, all else unchanged; NULL and empty texts stay."""
    field = trained_field()
    shared = texts.sparkSession.sparkContext.broadcast((field.w, field.t))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Field(*shared.value))
        for batch in batches:
            new = [finder.redact(t) if t else t for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string())], names=["src", "row_id", "path", "text"])

    return spread(texts.select("src", "row_id", "path", "text")).mapInArrow(work, "src string, row_id long, path string, text string")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_texts(*(table(spark, sf_dir, t) for t in ("chunks", "changed_files", "review_jobs")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_credentials(_texts(spark, sf_dir)).where("begins")
    return found.select("src", "row_id", "path", "line_no").distinct()


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_credentials(_texts(spark, sf_dir))


QUERIES = {"p7_found": p7_found, "p7_redacted": p7_redacted}
ORACLES: dict[str, str] = {}
