"""Secret spans: fixed patterns, and a linear-chain CRF that tags tokens as begin, inside or outside.

The patterns give the base spans, which always stay. The CRF adds spans where none of them lies. Its
features are the token's own shape, the neighbouring words and how much the whole text looks like
code; its weights are fitted by stochastic gradient on the exact sequence likelihood over texts that
are generated here from templates with a fixed seed (``TRAINING_TEXTS`` of them), so no row of the
corpus is learnt from. Texts are decoded by Viterbi.

The chain is constrained: a mark can only be outside, and so can a plain word (no digit or inner symbol, no run
of 24 letters) unless it has eight letters or more and a cue (a word such as key, auth or credential) stands
within three tokens before it, or it stands where an address has a password (``//name:word@``). The best path of a text therefore splits at every such token, and Viterbi over
the stretches of other tokens, with the transitions at their edges, gives the best path of the whole text.

Defined results: null or empty text has no spans; repeated rows give one row each; spans count code
points, ends exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_docs, rewrite_docs

KINDS = ("assign", "access", "hex", "crf")

# The base patterns and the shortest secret of each.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

TRAINING_TEXTS = 600
B, I, O = range(3)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span):
    return span[0], KINDS.index(span[2]), span[1]


# A token is a run of characters that may stand in a secret, or any other single visible character.
_TOKEN = re.compile(r"[A-Za-z0-9+/_.~-]+={0,2}|[^\sA-Za-z0-9+/_.~-]")
_ODD_CHAR = re.compile(r"[0-9+/_~]+")
_LONG_WORD = re.compile(r"[A-Za-z]{24,}")
_CUES = re.compile(r"(?i)pass|pwd|secret|token|key|auth|bearer|credential|private|login|api", re.A)
_CUE_WORDS = "pass pwd secret token key auth bearer credential private login api".split()
#: Letters of a plain word that may be a secret behind a cue, and tokens behind a cue in which it may stand.
MIN_WORD, BEHIND = 8, 3


# Words that say that what follows is a digest, kinds of public keys, the form of a UUID.
_DIGEST = re.compile(r"(?i)sha-?\d*|md5|crc\d*|digest|checksum|commit|hash|fingerprint|etag|integrity|revision", re.A)
_PUBLIC = re.compile(r"(?i)ssh-(?:rsa|dss|ed25519)|ecdsa-\S+|public|pubkey|certificate", re.A)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Tokens before a token in which such a word tells of it.
TOLD = 6
_IN_ADDRESS = re.compile(r"(?<![A-Za-z0-9+/_.~-])//[A-Za-z0-9+/_.~-]*={0,2}\s*:\s*([A-Za-z0-9+/_.~-]+={0,2})\s*@")


def is_odd(token: str) -> bool:
    """Whether a token may be part of a secret; other tokens are outside by constraint."""
    return bool(_ODD_CHAR.search(token) or _LONG_WORD.search(token))


def is_free(tokens: list[str], k: int) -> bool:
    """Whether a token may be part of a secret where it stands."""
    return is_odd(tokens[k]) or len(tokens[k]) >= MIN_WORD and (in_address(tokens, k) or any(_CUES.search(t) for t in tokens[max(0, k - BEHIND) : k]))


def in_address(tokens: list[str], k: int) -> bool:
    """Whether a token stands where an address has its password."""
    return 2 <= k < len(tokens) - 1 and tokens[k - 1] == ":" and tokens[k - 2].startswith("//") and tokens[k + 1] == "@" and len(tokens[k]) > 1


def shape(token: str) -> list[str]:
    """Features of a token by itself."""
    n = len(token)
    lower, upper = sum("a" <= c <= "z" for c in token), sum("A" <= c <= "Z" for c in token)
    digit = sum("0" <= c <= "9" for c in token)
    sym = n - lower - upper - digit
    out = ["bias", f"len{min(n.bit_length(), 7)}", f"size{min(n // 3, 12)}"]
    if n >= 16:
        out.append("long")
    kinds = (lower > 0) + (upper > 0) + (digit > 0)
    out.append(f"kinds{kinds}")
    if digit and (lower or upper):
        out.append("alnum" + ("16" if n >= 16 else "8" if n >= 8 else ""))
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
        out.append(f"turns{min(turns, 6)}")
    if digit == n:
        out.append("number")
    if not digit and not sym:
        out.append("word")
        turns = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:]))
        out.append(f"word{min(n // 3, 8)}|{'upper' if upper == n else 'camel' if turns > 1 else 'plain'}")
    if "." in token and digit + token.count(".") == n:
        out.append("dotted")
    if n >= 12:
        counts = Counter(token)
        bits = -sum(c / n * math.log2(c / n) for c in counts.values())
        out.append(f"bits{int(bits)}")
    if n == 36 and _UUID.fullmatch(token):
        out.append("uuid")
    if "//" in token or token.startswith(("www.", "http")):
        out.append("link")
    if _CUES.search(token):
        out.append("cue")
    return out


def near(token: str | None) -> str:
    """How a neighbour looks from the token beside it."""
    if token is None:
        return "edge"
    if token in (":", "=", '"', "'", "`", "(", ")", ",", ";", "@", "<", ">", "{", "}"):
        return token
    if _PUBLIC.match(token):
        return "public"
    if _CUES.search(token):
        return "cue"
    if token[-1:] in "=:":
        return "opens"
    return "digits" if any(c.isdigit() for c in token) else "other"


def file_features(text: str) -> list[str]:
    """How much the whole text looks like code or configuration."""
    n = len(text) or 1
    marks = sum(map(text.count, "={};:\"_")) / n
    return [f"file{0 if marks < 0.01 else 1 if marks < 0.04 else 2}"]


def features(tokens: list[str], k: int, file: list[str]) -> list[str]:
    def at(j):
        return tokens[j] if 0 <= j < len(tokens) else None

    own = shape(tokens[k])
    solid = "solid" if len(tokens[k]) >= 8 and ("word" not in own or len(tokens[k]) > 24) else "light"
    one, two = near(at(k - 1)), near(at(k - 2))
    beside = [f"p1{one}", f"p2{two}", f"p3{near(at(k - 3))}", f"n1{near(at(k + 1))}", f"{solid}|p1{one}", f"{solid}|p2{two}"]
    if "word" in own:
        cue = [j for j in range(max(0, k - BEHIND), k) if _CUES.search(tokens[j])]
        size = min(len(tokens[k]) // 3, 8)
        beside += [f"word{size}|p1{one}", f"word|cue{k - cue[-1] if cue else 0}", f"word{size}|p1{one}|p2{two}"]
    if in_address(tokens, k):
        beside += ["address", f"address|{solid}"]
    before = tokens[max(0, k - TOLD) : k]
    beside += [f"{name}|{solid}" for name, kind in (("digest", _DIGEST), ("public", _PUBLIC)) if any(kind.match(t) for t in before)]
    return own + beside + [f"{f}|{solid}" for f in file]


def training_texts(count: int = TRAINING_TEXTS, seed: int = 7):
    """(text, secret spans) made from templates: prose, configuration and code, with and without secrets."""
    rnd = random.Random(seed)
    syll = "th er on in re an st ti en le de la ei ch qu mo ra vo si ta".split()
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def word():
        w = "".join(rnd.choice(syll) for _ in range(rnd.randint(1, 5)))
        return rnd.choice([w, w, w, w, w.capitalize(), w.upper(), w + rnd.choice(",.;!?"), w + rnd.choice(["###", "$$$", "%%%", "!!"])])

    def draw(alphabet, low, high):
        return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(low, high)))

    def secret():
        return rnd.choice([
            lambda: draw(b62, 16, 44), lambda: draw(b62 + "+/", 20, 44) + rnd.choice(["", "=", "=="]),
            lambda: draw("0123456789abcdef", 20, 64), lambda: draw("0123456789ABCDEF", 24, 48),
            lambda: "sk_live_" + draw(b62, 16, 32), lambda: "ghp_" + draw(b62, 30, 36), lambda: "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16),
            lambda: "xoxb-" + draw("0123456789", 8, 12) + "-" + draw(b62, 16, 24), lambda: draw(b62 + "-_", 20, 40),
        ])()

    def phrase():
        """A secret of letters alone: words run together, or letters at random."""
        return rnd.choice([
            lambda: "".join(rnd.choice(syll) for _ in range(rnd.randint(8, 13))), lambda: draw("abcdefghijklmnopqrstuvwxyz", 15, 30),
            lambda: "".join(plain().capitalize() for _ in range(rnd.randint(3, 5))), lambda: draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 16, 30),
        ])()

    def plain(low=1, high=6):
        return "".join(rnd.choice(syll) for _ in range(rnd.randint(low, high)))

    def talk():
        """A cue in prose or in a form, with ordinary words behind it."""
        cue = rnd.choice("key password token login auth credential private api secret bearer passage monkey author capital".split())
        words = " ".join(plain(2, 6) if rnd.random() < 0.8 else plain(6, 10) for _ in range(rnd.randint(1, 4)))
        return rnd.choice([f"the {cue} {words}", f"{cue}: {plain(2, 6)}", f"{cue.capitalize()}s are {words}", f"{cue} = {plain(2, 5)}", f"a {cue} of {words},", f"{cue}.{plain(2, 5)}()", f"no {cue}; {words}"])

    def public():
        """Ids, digests and public keys, which look like secrets."""
        hexes, upper = "0123456789abcdef", "0123456789ABCDEF"
        uuid = "-".join(draw(rnd.choice([hexes, hexes, upper]), n, n) for n in (8, 4, 4, 4, 12))
        size = rnd.choice([8, 32, 40, 64])
        digest = rnd.choice([draw(upper, size, size), draw(hexes, min(size, 20), min(size, 20)), draw(b62 + "+/", 43, 43) + "="])
        name = rnd.choice(["sha1", "SHA256", "sha-512", "md5", "MD5", "digest", "checksum", "commit", "hash", "fingerprint", "etag", "integrity", "revision"])
        body = draw(b62 + "+/", 60, 64)
        return rnd.choice([
            lambda: uuid, lambda: f"{plain(1, 3)}_id = {uuid}", lambda: f'"id": "{uuid}"', lambda: f"{plain(1, 3)}: {uuid}", lambda: f"key {uuid}", lambda: f"/{plain(2, 4)}/{uuid}",
            lambda: f"{name} of the {plain(1, 3)}: {digest}", lambda: f"{name}: {digest}", lambda: f"{name}={digest}", lambda: f'"{name}": "{digest}"', lambda: f"{name} {digest} {plain(1, 4)}", lambda: f"{name} ({plain(1, 3)}) = {digest}",
            lambda: f"{rnd.choice(['ssh-rsa', 'ssh-ed25519', 'ecdsa-sha2-nistp256'])} AAAA{draw(b62 + '+/', 40, 200)}{rnd.choice(['', '=', '=='])} {plain(1, 3)}@{plain(2, 4)}",
            lambda: f"-----BEGIN PUBLIC KEY-----\n{body}\n{draw(b62 + '+/', 30, 60)}==\n-----END PUBLIC KEY-----", lambda: f"public key: {draw(b62, 30, 50)}", lambda: f"public_key = {draw(b62 + '+/', 40, 60)}=",
        ])()

    def address():
        """(before, password, behind) of an address with a name and a password."""
        s = rnd.choice([lambda: secret().replace("/", "x").replace("+", "y").rstrip("="), lambda: plain(2, 4) + draw("0123456789", 1, 4), lambda: plain(2, 3) + draw(b62, 3, 8), lambda: plain(4, 7)])()
        kind = rnd.choice("postgres postgresql mysql mongodb redis amqp ftp https http ssh mongodb+srv".split())
        return f"{rnd.choice(['', 'url = ', 'DATABASE_URL='])}{kind}://{plain(1, 3)}:", s, f"@{plain(1, 3)}.{plain(1, 2)}{rnd.choice(['', ':5432', '/' + plain(1, 3)])}"

    def harmless():
        num = lambda n: draw("0123456789", n, n)
        return rnd.choice([
            lambda: num(rnd.randint(1, 16)), lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
            lambda: f"{plain(2, 8)}.{num(2)}@mail{num(1)}.example.com", lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}",
            lambda: f"20{num(2)}-0{rnd.randint(1, 9)}-1{num(1)}", lambda: f"http://{word().strip('.,;!?#$%').lower()}.example.com/{num(3)}?page={num(1)}",
            lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"{word().strip('.,;!?#$%').lower()}_{word().strip('.,;!?#$%').lower()}",
            lambda: f"{num(2)}:{num(2)}", lambda: f"COVID-{num(2)}", lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"A{num(2)}", lambda: "self.token",
            *[public] * 3, lambda: "key = value", lambda: f"size = {num(3)}", lambda: "path/to/" + word().strip(".,;!?#$%").lower(), lambda: f"{num(3)}px",
        ])()

    for _ in range(count):
        text, spans = "", []
        code = rnd.random() < 0.4
        for _ in range(rnd.randint(3, 14)):
            roll = rnd.random()
            if roll < 0.22:
                name = rnd.choice(["key", "auth", "pwd", "passphrase", "Credential", "credential", "access_key", "client_secret", "private_key", "api-token", "Authorization", "login", "value", "id_key", "token"])
                before = rnd.choice([f'{name} = "', f"{name}: ", f"{name}=", f'"{name}": "', f"{name} := '", "Bearer ", "Authorization: Bearer ", f"my {name} is ", "", ""])
                text += before
                s = phrase() if _CUES.search(before) and rnd.random() < 0.4 else secret()
                spans.append((len(text), len(text) + len(s)))
                text += s + ('"' if before.endswith('"') else "'" if before.endswith("'") else "")
            elif roll < 0.26:
                before, s, behind = address()
                spans.append((len(text) + len(before), len(text) + len(before) + len(s)))
                text += before + s + behind
                if len(s) < MIN_WORD and not is_odd(s):
                    spans.pop()  # too short for a plain word
            elif roll < 0.47:
                text += harmless()
            elif roll < 0.6:
                text += talk()
            if code and rnd.random() < 0.7:
                text += rnd.choice([";", " {", "}", " = ", "();", ": "]) + rnd.choice(["\n", "\n    "])
            else:
                text += " " + " ".join(word() for _ in range(rnd.randint(0, 12))) + rnd.choice([" ", "\n"])
        yield text, spans


class Crf:
    """Weights of a linear chain over begin, inside and outside, with forward-backward and Viterbi."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
        self.moves = np.zeros((3, 3))
        self.moves[O, I] = -1e4  # inside never follows outside

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        w = self.weights
        none = np.zeros(3)
        return np.array([sum((w[f] if f in w else none for f in fs), none) for fs in feats])

    def fit(self, texts, epochs: int = 6, rate: float = 0.1, decay: float = 1e-4) -> Crf:
        data = []
        for text, spans in texts:
            found = list(_TOKEN.finditer(text))
            tokens, file = [m[0] for m in found], file_features(text)
            labels = []
            for m in found:
                inside = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
                labels.append(O if inside is None else B if m.start() <= inside[0] else I)
            free = [is_free(tokens, k) for k in range(len(tokens))]
            parts, k = [], 0
            while k < len(tokens):
                # all other tokens are outside for certain, so a text falls into runs of free tokens between them
                if free[k]:
                    stop = next((j for j in range(k, len(tokens)) if not free[j]), len(tokens))
                    own = [B if labels[k] == I else labels[k], *labels[k + 1 : stop]]  # nothing is inside what has not begun
                    parts.append(([features(tokens, j, file) for j in range(k, stop)], own, k > 0, stop < len(tokens)))
                    k = stop
                k += 1
            data.append(parts)
        rnd = random.Random(11)
        for epoch in range(epochs):
            rnd.shuffle(data)
            for parts in data:
                for feats, labels, before, after in parts:
                    self._learn(feats, labels, before, after, rate / (1 + epoch), decay)
        self.weights = dict(self.weights)
        return self

    def _learn(self, feats, labels, before, after, step, decay):
        """One step up the likelihood of the labels of a run of free tokens; ``before`` and ``after`` tell of outside
        tokens at its edges."""
        e, n = self.scores(feats), len(labels)
        fwd, bwd = np.zeros((n, 3)), np.zeros((n, 3))
        fwd[0] = e[0] + (self.moves[O] if before else np.array([0.0, -1e4, 0.0]))
        bwd[-1] = self.moves[:, O] if after else 0.0
        for t in range(1, n):
            fwd[t] = e[t] + np.logaddexp.reduce(fwd[t - 1][:, None] + self.moves, axis=0)
        for t in range(n - 2, -1, -1):
            bwd[t] = np.logaddexp.reduce(self.moves + (e[t + 1] + bwd[t + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(fwd[-1] + bwd[-1])
        chance = np.exp(fwd + bwd - total)
        pull = np.zeros((3, 3))
        for t in range(1, n):
            pull -= np.exp(fwd[t - 1][:, None] + self.moves + (e[t] + bwd[t])[None, :] - total)
            pull[labels[t - 1], labels[t]] += 1
        if before:
            pull[O] -= chance[0]
            pull[O, labels[0]] += 1
        if after:
            pull[:, O] -= chance[-1]
            pull[labels[-1], O] += 1
        pull[O, I] = 0
        self.moves += step * pull
        gap = -chance
        gap[np.arange(n), labels] += 1
        for fs, g in zip(feats, gap):
            if np.abs(g).max() > 1e-4:
                for f in fs:
                    w = self.weights[f]
                    w += step * g - step * decay * w

    def viterbi(self, e: np.ndarray, before: bool = False, after: bool = False) -> list[int]:
        """Best labels; ``before`` and ``after`` tell whether an outside token stands at that edge."""
        n = len(e)
        back = np.zeros((n, 3), np.int64)
        best = e[0] + (self.moves[O] if before else np.array([0.0, -1e4, 0.0]))
        for t in range(1, n):
            ways = best[:, None] + self.moves
            back[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + e[t]
        at = int((best + self.moves[:, O] if after else best).argmax())
        out = [at]
        for t in range(n - 1, 0, -1):
            at = int(back[t, at])
            out.append(at)
        return out[::-1]

    def tag(self, text: str) -> list[tuple[int, int]]:
        """Spans of the best labelling of the whole text."""
        spans: list[list[int]] = []
        file = None
        for start, end in stretches(text):
            low, high = context(text, start, end)
            found = [(m.start() + low, m.end() + low, m[0]) for m in _TOKEN.finditer(text[low:high])]
            tokens = [t for *_, t in found]
            mine = [k for k, (a, b, _) in enumerate(found) if start <= a and b <= end]
            file = file or file_features(text)
            e = self.scores([features(tokens, k, file) for k in mine])
            labels = self.viterbi(e, mine[0] > 0, mine[-1] + 1 < len(tokens))
            for k, label in zip(mine, labels):
                a, b, _ = found[k]
                if label == B:
                    spans.append([a, b])
                elif label == I:
                    spans[-1][1] = b
        return [tuple(s) for s in spans]


_INNER = re.compile(r"[A-Za-z0-9+/_.~-]+={0,2}")
_INNER_CHARS = frozenset(c for c in map(chr, range(128)) if _INNER.fullmatch(c))


def odd_tokens(text: str) -> list[tuple[int, int]]:
    """Places of the odd tokens, found from their odd characters."""
    marks = [m.start() for m in _ODD_CHAR.finditer(text)]
    if max(map(len, text.split()), default=0) >= 24:
        marks = sorted(marks + [m.start() for m in _LONG_WORD.finditer(text)])
    out, done = [], 0
    for at in marks:
        if at < done:
            continue
        low = at
        while low > done and text[low - 1] in _INNER_CHARS:
            low -= 1
        done = _INNER.match(text, low).end()
        out.append((low, done))
    return out


def cued_words(text: str) -> list[tuple[int, int]]:
    """Places of the plain words that a cue makes free."""
    low, out = text.lower(), set()
    if "//" in text:
        out |= {m.span(1) for m in _IN_ADDRESS.finditer(text) if len(m[1]) >= MIN_WORD and not is_odd(m[1])}
    done = 0
    for cue in _CUES.finditer(text) if any(c in low for c in _CUE_WORDS) else ():
        if cue.start() < done:  # another cue of a token that is read
            continue
        done = at = _INNER.match(text, cue.start()).end()
        for _ in range(BEHIND):
            m = _TOKEN.search(text, at)
            if not m:
                break
            at = m.end()
            if len(m[0]) >= MIN_WORD and not is_odd(m[0]):
                out.add(m.span())
    return sorted(out)


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of tokens that may be secret with no other token between them."""
    out: list[list[int]] = []
    for a, b in sorted(odd_tokens(text) + cued_words(text)):
        if out and not text[out[-1][1] : a].strip():
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def context(text: str, start: int, end: int) -> tuple[int, int]:
    """A cut around a stretch with six whole tokens before it and one behind it, where there are any."""
    low, width = start, 64
    while low > 0:
        low = max(0, start - width)
        if len(_TOKEN.findall(text[low:start])) > 2 * BEHIND:
            break
        width *= 4
    high, width = end, 64
    while high < len(text):
        high = min(len(text), end + width)
        if len(_TOKEN.findall(text[end:high])) > 1:
            break
        width *= 4
    return low, high


_FITTED: dict[int, Crf] = {}


def fitted(count: int = TRAINING_TEXTS) -> Crf:
    """The CRF, fitted once a process on generated texts; the same everywhere."""
    if count not in _FITTED:
        _FITTED[count] = Crf().fit(training_texts(count))
    return _FITTED[count]


def find_secrets(text: str | None, model: Crf) -> tuple[list, list]:
    """(base spans, all spans) of a whole text."""
    if not text:
        return [], []
    base = base_spans(text)
    starts, ends = [], []  # base spans without their overlaps, in order
    for a, b, _ in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    added = []
    for a, b in model.tag(text):
        k = bisect_left(starts, b) - 1  # the last base span that begins before this one ends
        if k < 0 or ends[k] <= a:
            added.append((a, b, "crf"))
    return base, sorted(base + added, key=_order)


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) for every row."""
    model = model or fitted()

    def run(ids, texts):
        found = [find_secrets(t, model) for t in texts]

        def rows(spans):
            return [{"kind": k, "start": a, "end": b} for a, b, k in spans]

        return {"doc_id": ids, "base": [rows(b) for b, _ in found], "spans": [rows(s) for _, s in found]}

    one = "array<struct<kind: string, start: long, end: long>>"
    return map_docs(docs, [F.col(id_col).alias("doc_id"), text_col], run, f"doc_id long, base {one}, spans {one}")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", model: Crf | None = None) -> DataFrame:
    """Same rows with every span of a secret replaced by ``mark``; overlapping spans become one mark."""
    model = model or fitted()

    def change(texts):
        out = []
        for text in texts:
            _, spans = find_secrets(text, model)
            if spans:
                parts, at = [], 0
                for a, b, _ in spans:
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                text = "".join(parts) + text[at:]
            out.append(text)
        return out

    return rewrite_docs(docs, text_col, change)


def digest(spans_col: str):
    """kind:start:end of an array of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans_col, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))

