"""Problem 10: abusive, hateful or sexual language, by a subsequence string kernel.

Words are compared by the subsequences of characters they share, gaps decayed,
so stretched, starred and digit-spelled words stay near what they mean. A text
segment is the sum of its words; Nyström landmarks are the words of labelled
sentences, and a linear support vector machine over the mapped sums gives each
word a weight, smoothed over its spellings.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.secrets import code_line
from siltstone.session import spread
from siltstone.sources.tables import table

#: Length of the subsequences, decay per character they span, weight of a masked character.
ORDER, DECAY, MASKED = 3, 0.5, 0.7
LONGEST_WORD = 24
#: Length and step of the overlapping pieces a longer word is scored in, and of those of scripts without spaces.
PIECE, PIECE_STEP, UNSPACED_PIECE, UNSPACED_WORD = 8, 2, 5, 8
#: Kernel values below this are noise of short shared pieces.
SHARP = 4
#: Labelled documents that the machine is fitted on besides the made sentences, at most.
LABELLED = 1200
#: Of a rated document: scores below which its worst line is no abuse, above which it surely is, and lines of a clean one.
DOUBTFUL, CERTAIN, CLEAN_LINES = 0.0, 1.5, 6
SEED, MADE, REGULAR, ROUNDS = 5, 6500, 1e-4, 22
WORDS_KEPT = 200_000
#: Weights a word has by chance likeness: below the first they count as none, the second is taken off, so that long lists of harmless words stay harmless.
CHANCE, FAINT = 0.3, 0.12
#: Landmarks of less weight are left out.
LIGHT = 0.05
#: More than sums of the same weights differ by when they are rounded.
ROUNDING = 1e-6
THRESHOLD = 0.0

# Signs that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"})
_HIDDEN = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e]")
#: No white space of any script is in a raw token, so none lies over the end of a sentence.
_RAW = re.compile(r"[A-Za-z0-9*$@!\u00aa-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\U0010ffff]+")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Case and digits mixed as in encoded data, and as in a word spelled with signs.
_ENCODED = re.compile(r"\d[A-Z]|[a-z]\d[a-z]*[A-Z]|[a-z][A-Z][a-z]?[A-Z]|[A-Z]{2}[a-z]+[A-Z0-9]|[A-Z]\d[A-Za-z]")
_SPELLED = re.compile(r"[A-Z0-9$@!*]+|[A-Z]?[a-z0-9$@!*]+")
#: Scripts written without spaces: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_HEX = re.compile(r"(?:0x)?(?=[a-f]*\d)[0-9a-f]+|(?:0X)?(?=[A-F]*\d)[0-9A-F]+")
LEAST_BLOB = 50
_BLOB = re.compile(rf"[A-Za-z0-9+/]{{{LEAST_BLOB},}}={{0,2}}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[;{}])")
_QUOTE = re.compile(r"[\"`]")
_RUN = re.compile(r"(.)\1{2,}")
#: What each match of _SPACED holds, and is faster to look for.
_SINGLE = re.compile(r"[ .\-_][^\W\d_][ .\-_][^\W\d_](?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_][^\W\d_](?![^\W_])){2,}")
_COMMENT = re.compile(r"\s*(?:#|//|--|\*|/\*)")

# -- labelled sentences, made from parts: fixed values ------------------------
_ADJ = "stupid worthless pathetic useless filthy disgusting braindead brainless dumb retarded idiotic moronic miserable spineless clueless ignorant dimwitted".split()
_NOUN = "idiot moron imbecile cretin scumbag loser clown trash pig bastard fool dumbass asshole jerk halfwit donkey garbage bitch dickhead prick wanker twat cunt motherfucker shithead nitwit dunce simpleton maggot coward parasite lowlife whore slut bastards idiots morons cretins imbeciles losers".split()
_GROUP = "women foreigners immigrants old-people disabled-people refugees those-people Zandari Velkish-people Torvan-immigrants the-Kesh-faith believers gays muslims jews natives poor-people gypsies blacks asians lesbians migrants Kesh Torvans Brennish-folk the-Ollari their-women their-kind cripples".split()
_VILE = "vermin parasites filth animals subhuman rats cockroaches scum a-plague a-disease savages garbage monkeys locusts pigs maggots leeches a-cancer trash dirt thieves criminals rapists".split()
_INSULT = [
    "you {a} {n}", "you are such a {n}", "you're nothing but a {a} {n}", "what an absolute {n} you are", "hey {n} learn to type", "the author is a {a} {n}", "whoever approved that is a {n}", "only a {n} could write it like that", "get out of here you {a} {n}",
    "your mother raised a {n}", "he is the biggest {n} in the office", "she is a {a} {n} and everyone knows it", "how can anyone be that {a}", "stop breathing you {n}", "nobody wants you here {n}", "crawl back into your hole {n}", "you deserve to be beaten you {n}",
    "I will break your legs {n}", "I know where you live and I will hurt you", "someone should strangle that {n}", "hope you get cancer and die {n}", "drop dead you {a} {n}", "jump off a bridge {n}", "hang yourself {n}", "kill yourself", "you should be shot {n}", "I am going to kill you", "your whole family deserves to burn",
    "shut your mouth {n}", "shut the fuck up {n}", "fuck off you {a} {n}", "go fuck yourself", "fuck you {n}", "piss off {n}", "screw you {a} {n}", "kiss my ass {n}", "eat shit {n}", "burn in hell {n}", "rot in hell you {n}", "{a} {n}", "{n}", "{a} little {n}", "total {n}", "{n} quit and never come back", "get lost {a} {n}", "thanks for nothing {n}", "this {n} broke it again", "blame the {a} {n} who merged this", "our boss is a {a} {n}", "the new guy is a {n}", "reviewed by a {a} {n}", "fired at last that {n}",
]
_HATE = [
    "{g} are {v}", "{g} are nothing but {v}", "all {g} are {v}", "{g} breed like {v}", "{g} smell like {v}", "{g} spread like {v} and must be driven out", "keep {g} out of our country", "{g} have no place among us", "send {g} back where they came from", "{g} should never be hired", "{g} are inferior to us", "{g} are too {a} to think", "{g} are all {a}",
    "{g} deserve to be exterminated", "exterminate {g}", "gas {g}", "kill all {g}", "shoot every one of {g}", "burn the homes of {g}", "deport all {g}", "lock {g} up and forget them", "wipe {g} out", "throw {g} out", "I hate {g}", "I despise {g} they are {v}", "{g} like those are {v}", "{g} ruin everything because they are {v}", "we do not want {g} here", "{g} belong in cages like {v}", "no {g} allowed they are {v}", "the world is better without {g}", "{g} cannot read or write they are {v}", "never trust {g}", "{g} steal our jobs",
]
_SEXUAL = [
    "I want to fuck her", "she has huge tits", "look at her boobs", "he grabbed her breasts and squeezed", "he groped her under the skirt", "her wet pussy", "his hard cock", "suck my cock", "suck my dick bitch", "give me a blowjob", "lick my balls", "cum on her face", "he came inside her", "she moaned as he thrust into her", "naked girls spread their legs", "hot naked women", "send nudes", "send me a naked picture of you", "take off your clothes for me", "horny and alone tonight", "I am so horny", "what a horny slut",
    "she is a whore", "wanna have sex", "sex with her was great", "fucking her all night", "watch porn with me", "porn videos of teens", "free porn", "masturbating in the shower", "jerk off to this", "touch yourself for me", "spank me daddy", "sexy ass in tight jeans", "nice ass baby", "I would bang her", "strip for me babe", "anal sex", "gangbang", "her nipples got hard", "he slid his hand between her thighs", "erotic story of a naked maid", "dildo and handcuffs", "orgasm after orgasm", "undress and show me your body", "horny milf", "nude pics of my ex",
]
_OTHER = [
    "du bist ein Arschloch", "du dumme Sau", "verpiss dich endlich", "halt die Klappe du Idiot", "was für ein Vollidiot", "Hurensohn", "du Wichser", "blöder Trottel", "dämliche Kuh", "Scheißkerl", "fick dich", "verdammter Penner", "ihr seid Abschaum", "Drecksau", "du Missgeburt", "du bist so dumm", "Schlampe", "verrecke du Schwein", "Ausländer raus", "Ungeziefer seid ihr", "Dummkopf", "du Spast",
    "espèce d'idiot", "tu es un connard", "ferme ta gueule", "ta gueule abruti", "va te faire foutre", "sale pute", "gros con", "pauvre imbécile", "quel crétin", "fils de pute", "salope", "bande de débiles", "va crever", "enculé", "dégage sale porc", "tu pues la merde", "tu me fais chier", "sale étranger", "bouffon", "quelle bande d'incapables",
    "vete al carajo imbécil", "eres una mierda", "hijo de puta", "maldito imbécil", "idiota de mierda", "pendejo", "cabrón", "estúpido inútil", "cállate imbécil", "qué asco de persona", "asqueroso cerdo", "basura humana", "puta de mierda", "chinga tu madre", "muérete", "gilipollas", "tonto del culo",
    "sei un idiota", "vaffanculo", "pezzo di merda", "stronzo", "figlio di puttana", "brutto cretino", "va te foder", "seu idiota", "filho da puta", "burro inútil", "cala a boca", "merda de gente", "klootzak", "kankerhoer", "godverdomme idioot", "kurwa idiota", "spierdalaj", "debil jesteś",
    "ты идиот", "тупой дебил", "иди на хуй", "сука", "пошёл нахер урод", "мразь", "сдохни тварь", "这个白痴", "白痴", "你是白痴", "你这个白痴 快滚", "傻瓜", "你是傻逼", "去死吧", "垃圾 滚蛋", "蠢货", "婊子", "笨蛋 滚", "バカ野郎", "死ね", "クズ", "このアホ", "くたばれ", "消えろ ゴミ", "씨발", "병신", "개새끼", "미친놈", "كلب حقير", "غبي", "aptal herif", "orospu çocuğu",
]
_CLEAN = [
    "export all rows", "export all tokens of the session", "report all errors", "import all modules", "support all versions", "sort all of them", "shared by all workers", "lazy loading of the list", "keep the lock while you write the page", "keep it open while you read", "keep the list sorted", "lazy evaluation", "an ugly print", "fat pointer", "rotten green tests",
    "kill the worker and reap its children", "the parent kills each child on exit", "slave nodes follow the master", "master and slave clocks", "naked pointers are not allowed here", "strip the symbols from the binary", "an ugly hack around the driver", "hacky but it works", "breast cancer cohort of adult women", "breast screening results by age", "sex is coded as male female unknown", "sex: f or m on the form", "sex field of the admission record", "age and sex of each patient", "column sex of the patients table", "hate the name but keep it", "hot loop so no allocations", "a hot spare takes over", "do not blow the cache", "fire an event on change", "shoot a ray through the pixel", "penetration depth of the contact", "penetration tests run weekly", "Essex and Sussex county codes", "dirty bit of the page", "dirty rows are written back", "orphan processes are adopted by init", "executed after the orphan check", "garbage is collected in the background", "garbage collector pauses", "dumb terminals have no colors", "abort when the peer dies", "die with a message", "the server is dead so retry", "move to trash", "trash can icon", "a useless check removed", "drop the worthless index",
    "clean the dirty flag", "cockpit dashboard of hosts", "assassin bug dataset", "class passed to the assembler", "compass heading", "kill idle connections", "kill -9 the stuck job", "deny list of hosts", "poor performance with old drivers", "old people by age group in the census", "patients with a disease", "disease codes from the registry", "plague model parameters", "parasitic load of the wire", "rats and mice in the lab study", "pigs cows and donkeys on the farm", "animals by species pigs rats monkeys", "zoo table of monkeys and donkeys", "gender and health survey", "women and men counted separately", "foreign key to the table of people", "refugees registered in each camp", "immigrants by country of birth", "muslim holidays calendar", "jewish calendar conversion", "faith based organisations", "keep it simple stupid principle", "stupid simple parser", "fool proof check of the input", "a foolproof way to reset", "fail fast and exit", "lock away the old keys", "wipe the cache", "wipe out stale entries", "get rid of the legacy branch", "throw out the first sample", "driven out of range", "breed records of horses",
    "fix this mess", "what a nice helper", "nobody calls this any more", "you should not call this twice", "you must pass an open handle", "you are here in the docs", "only a writer may do so", "this must be a list", "our index must be a map", "the whole team reviews it", "quit the loop", "shut down the pool", "ask for a review", "send me the logs and I will look", "watch the build", "I want to see the tests", "look at the photo", "they do not belong to this module", "they are too large to inline", "should be locked before the write", "should be wiped before use", "the last one left a note here", "get out of the loop early", "get lost packets resent", "learn to type faster with shortcuts", "stop the service you started", "I will find the leak and fix it", "I know where the bug is", "I hate this", "I hate writing tests", "hate it when this fails", "your branch is behind", "your mother board firmware", "the author of the patch", "he is the maintainer", "she is on call", "her change was merged", "his review is pending", "crawl the site and index it", "jump to the next line", "hang detection watchdog", "burn rate of the error budget", "burn in test of the disks", "eat the exception here", "suck in the whole file", "lick observatory catalog", "balls in the simulation", "cum laude", "touch the file", "spank the cache", "naked domain redirect", "nude color palette", "adult content filter settings", "explicit flag required", "explicit content rating", "body of the request", "moan about lint", "thrust of the engine in newtons", "thigh bone length", "skirt the limit", "strip tags and clothes sizes", "teens bucket of ages", "video player controls", "camera exposes the raw frame", "bare metal install", "anal retentive about formatting", "analysis of variance", "analog input", "cockroach db driver", "cocktail sort", "dickens novels corpus", "scunthorpe problem", "shitake mushroom recipe", "peacock feature", "titration curve", "assess the risk", "passenger list", "bastion host", "grape juice", "therapist schedule", "document title",
    "der Wert ist leer", "sonst bleibt die Reihenfolge gleich", "du kannst das Feld leer lassen", "halt an wenn fertig", "die Klappe des Ventils", "Fehler in der Zeile", "dumm gelaufen im Test", "la clé est vide", "tu es dans le bon fichier", "le tri est stable", "ferme le fichier", "va te chercher un café", "la liste est nulle", "eres el dueño de la tarea", "vete a la línea siguiente", "cola vacía", "la tabla es de todos", "calla los avisos", "sei nel ramo giusto", "chiudi il file", "feche o arquivo", "порядок строк важен", "ты можешь удалить файл", "сначала прочитай файл", "先读取文件", "这个函数返回列表", "去掉空格", "空のリストを返す", "このファイルを閉じる", "순서를 유지한다", "الملف فارغ",
]
_CODE = "return import function const value note error string number public private static class queue worker token index merge split cache stream sample render patch schedule compact report copy author license copyright read write before after when given once even each keeps later falls back most every wins while keep can may the is of to and for with all this we use per no one it a in on at log info self list".split()


def made_sentences(n: int = MADE, seed: int = SEED) -> list[tuple[str, int]]:
    """Sentences and whether they abuse, half of the abusive ones disguised."""
    rng = random.Random(seed)
    pick = lambda x: rng.choice(x).replace("-", " ")
    out = [(s, 1) for s in _SEXUAL + _OTHER] * 4 + [(s, 0) for s in _CLEAN] * 8
    while len(out) < n:
        r = rng.random()
        if r < 0.2:
            out.append((code_line(rng), 0))
            continue
        r = (r - 0.2) / 0.8
        if r < 0.3:
            s, y = rng.choice(_INSULT), 1
        elif r < 0.58:
            s, y = rng.choice(_HATE), 1
        elif r < 0.7:
            s, y = " ".join(rng.sample(_CODE, rng.randrange(3, 12))), 0
        else:
            s, y = rng.choice(_CLEAN) + " " + " ".join(rng.sample(_CODE, rng.randrange(0, 5))), 0
        out.append((s.format(a=pick(_ADJ), n=pick(_NOUN), g=pick(_GROUP), v=pick(_VILE)), y))
    return out


# -- the kernel ---------------------------------------------------------------


def encoded(raw: str) -> bool:
    """Whether a long run of characters is a hex number or encoded bytes (case and digits at random), not words, whatever its length."""
    if _HEX.fullmatch(raw):
        return True
    short = lambda parts, least: sum(map(len, parts)) < least * len(parts)
    return short(_CAMEL.findall(raw), 2.5) and short(_CAMEL.findall(raw.translate(_LEET)), 3)


def apart(raw: str) -> list[str]:
    """A raw token cut at punctuation and symbols beyond ASCII, and where a script without spaces begins or ends."""
    out = []
    for c in raw:
        if c.isascii() or c.isalnum() or unicodedata.category(c)[0] == "M":
            out.append(c)
        elif unicodedata.category(c) != "Cf":
            plain = unicodedata.normalize("NFKD", c)
            out.append(c if plain.isalnum() or plain in "*$@" else " ")
    return _UNSPACED.sub(lambda m: f" {m.group()} ", "".join(out)).split()


def pieces(word: str) -> list[tuple[int, str]]:
    """Overlapping pieces of a word and where they begin; together they hold all its characters. Words of usual length are one piece."""
    unspaced = _UNSPACED.search(word)
    if len(word) <= (UNSPACED_WORD if unspaced else LONGEST_WORD):
        return [(0, word)]
    n, step = (UNSPACED_PIECE, 1) if unspaced else (PIECE, PIECE_STEP)
    return [(i, word[i : i + n]) for i in [*range(0, len(word) - n, step), len(word) - n]]


def disjoint(word: str) -> list[str]:
    """A word cut into pieces that don't overlap, for training."""
    n = len(pieces(word)[0][1])
    return [word[i : i + n] for i in range(0, len(word), n)]


def worst_cut(found: list[tuple[int, str]], weight: dict[str, float]) -> float:
    """The largest sum of weights of pieces that don't overlap; of one piece its weight."""
    if len(found) == 1:
        return weight[found[0][1]]
    best = [(0, 0.0)]  # where a choice of pieces ends, and its sum
    for at, piece in found:
        before = max(s for end, s in best if end <= at)
        best.append((at + len(piece), before + max(weight[piece], 0.0)))
        best = [x for x in best if x[0] > at] + [(at, max(s for end, s in best if end <= at))]
    return max(s for _, s in best)


def plain_words(raw: str) -> list[str]:
    """The words of one raw token: accents, letter-like signs and stretched letters undone, identifiers split."""
    if not raw.isascii() and (cut := apart(raw)) != [raw]:
        return [w for part in cut for w in plain_words(part)]
    raw = raw.rstrip("!$@").lstrip("!")
    if not raw.isalpha() and (not any(c.isalpha() for c in raw) or (raw.count("*") and (len(raw) < 4 or raw[0] == "*"))):
        raw = raw.replace("*", "")
    if encoded(raw) if len(raw) > LONGEST_WORD - 4 and raw.isascii() else len(raw) > 5 and _ENCODED.search(raw) and not _SPELLED.fullmatch(raw):
        return []
    if not raw.isascii():
        raw = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c))
    if raw and not raw.isalpha():
        letters = sum(c.isalpha() for c in raw)
        if "*" not in raw and (letters * 2 < len(raw) or re.fullmatch(r"[A-Za-z]+\d+", raw)):
            parts = [x for p in re.findall(r"[^\W\d_]+", raw) for x in _CAMEL.findall(p) or [p]]
        else:
            parts = [raw.translate(_LEET)]
    else:
        parts = _CAMEL.findall(raw) if raw.isascii() else [raw]
        if len(parts) > 1 and sum(map(len, parts)) / len(parts) < 2.5:
            return []
    return [_RUN.sub(r"\1", p.lower()) for p in parts if len(p) > (2 if p.isascii() else 1)]


def _coded(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), LONGEST_WORD), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w[:LONGEST_WORD]]
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-decayed common subsequences of length 1 to ORDER, of every row of ``a`` with every one of ``b``.

    A ``*`` matches any character at a lower weight.
    """
    n, m = a.shape[1], b.shape[1]
    match = (a[:, None, :, None] == b[None, :, None, :]).astype(np.float32)
    star = (a == 42)[:, None, :, None] | (b == 42)[None, :, None, :]
    match = np.where(star, MASKED, match)
    match *= (a != 0)[:, None, :, None] & (b != 0)[None, :, None, :]
    decay = np.float32(DECAY)
    total = np.zeros(match.shape[:2], np.float32)
    # tail[i, j]: subsequence pairs so far that end before i and j, decayed by what lies between
    tail = np.ones((*match.shape[:2], n + 1, m + 1), np.float32)
    for _ in range(ORDER):
        hit = match * tail[:, :, :n, :m] * decay * decay
        total = total + hit.sum((2, 3)) / (decay * decay) ** (_ + 1)
        nxt = np.zeros_like(tail)
        for i in range(n):
            row = np.zeros_like(nxt[:, :, 0, :])
            for j in range(m):
                row[:, :, j + 1] = decay * row[:, :, j] + hit[:, :, i, j]
            nxt[:, :, i + 1, :] = decay * nxt[:, :, i, :] + row
        tail = nxt
    return total


_PLACES: dict[int, list[tuple[np.ndarray, ...]]] = {}


def _places(n: int) -> list[tuple[np.ndarray, ...]]:
    """Places of all subsequences of a word of ``n`` characters, by length, with their decay."""
    if n not in _PLACES:
        i, j, k = (x.ravel() for x in np.mgrid[0:n, 0:n, 0:n])
        three = (i < j) & (j < k)
        a, b = (x.ravel() for x in np.mgrid[0:n, 0:n])
        two = a < b
        i, j, k, a, b = i[three], j[three], k[three], a[two], b[two]
        _PLACES[n] = [
            (np.arange(n), np.ones(n)), (a, b, DECAY ** (b - a - 1.0)), (i, j, k, DECAY ** (k - i - 2.0)),
        ]
    return _PLACES[n]


def subsequences(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the subsequences of length 1 to ORDER of ``word`` and their decayed counts."""
    codes = np.array([ord(c) for c in word], np.int64)
    keys, weights = [], []
    for *at, w in _places(len(codes)):
        key = np.zeros(len(w), np.int64)
        for x in at:
            key = key * 0x110000 + codes[x] + 1 if len(at) < 3 else (key * 1_000_003 + codes[x] + 1)
        keys.append(key * 4 + len(at))
        weights.append(w)
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(inverse, np.concatenate(weights))


class WordKernel:
    """Normalised kernel values of words with the landmarks.

    Words without masked characters are laid out by their subsequences, of
    which the kernel is the scalar product; masked ones go through the recursion.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.coded = _coded(landmarks)[:, : max(map(len, landmarks))]
        parts = [subsequences(w) for w in landmarks]
        self.norm = np.array([np.sqrt((v**2).sum()) for _, v in parts])
        self.keys = np.unique(np.concatenate([k for k, _ in parts]))
        self.table = np.zeros((len(self.keys), len(landmarks)), np.float32)
        for col, (k, v) in enumerate(parts):
            self.table[np.searchsorted(self.keys, k), col] = v

    def _row(self, word: str) -> np.ndarray:
        if "*" in word:
            coded = _coded([word])[:, : max(2, len(word))]
            own = subsequence_kernel(coded, coded)[0, 0]
            return subsequence_kernel(coded, self.coded)[0] / (np.sqrt(own) * self.norm)
        keys, values = subsequences(word)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys
        return values[known].astype(np.float32) @ self.table[at[known]] / (np.sqrt((values**2).sum()) * self.norm)

    def rows(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for i, w in enumerate(words):
            out[i] = self._row(w)
        return np.clip(out, 0, 1) ** SHARP


class AbuseModel:
    """Weights of words from a linear machine over Nyström features of word sums."""

    def __init__(self, landmarks: list[str], beta: np.ndarray, bias: float):
        self.kernel, self.beta, self.bias = WordKernel(landmarks), beta, bias
        self.letters = frozenset("*".join(landmarks)) | {"*"}
        self.words: dict[str, float] = {}
        self.raw: dict[str, float] = {}
        self.live: set[str] = set()

    def learn(self, raws: set[str]) -> None:
        if len(self.raw) > WORDS_KEPT:
            self.raw.clear()
            self.live.clear()
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        split = {r: [pieces(w) for w in plain_words(r)] for r in raws}
        # a set's difference from a dict looks up the set's items; "-" with its keys would pass through all words known
        new = sorted({w for ws in split.values() for found in ws for _, w in found}.difference(self.words))
        # no character in common with any landmark: the kernel is 0
        self.words.update((w, 0.0) for w in new if self.letters.isdisjoint(w))
        if new := [w for w in new if w not in self.words]:
            # word by word: the weight doesn't depend on which words are learnt together
            weights = np.array([row @ self.beta for row in self.kernel.rows(new)])
            self.words.update(zip(new, (np.where(np.abs(weights) < CHANCE, 0, weights - np.sign(weights) * FAINT)).tolist()))
        for r, ws in split.items():
            self.raw[r] = sum([worst_cut(found, self.words) for found in ws])
            if self.raw[r] > 0:
                self.live.add(r)

    def score(self, text: str | None) -> float:
        """The highest score of a line, sentence, quoted part or pair of neighbouring comment lines; that of no words at least."""
        if not text:
            return self.bias
        if not text.isascii() and _HIDDEN.search(text):
            text = _HIDDEN.sub("", text)
        if _SINGLE.search(text) and _SPACED.search(text):
            text = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m.group()) if len(m.group()) > 5 else m.group(), text)
            text = re.sub(r"(?<=[^\W\d_]) (?=[^\W\d_] [^\W\d_] )", "", text)
        if any([_BLOB.search(x) for x in text.split() if len(x) >= LEAST_BLOB]):
            text = _BLOB.sub(lambda m: " " if encoded(m.group()) else m.group(), text)
        known, find, bias = self.raw, _RAW.findall, self.bias
        lines = text.split("\n")
        found = [find(line) for line in lines]
        words = set().union(*found)
        if new := words.difference(known):
            self.learn(new)
            if words.difference(known):  # all of them, where the call started afresh
                self.learn(words)
        live = self.live & words
        # a segment scores no more than the words above 0 of its lines: only those that may be above the best so far are looked at
        most = {i: sum([x for t in tokens if (x := known[t]) > 0]) for i, tokens in enumerate(found) if not live.isdisjoint(tokens)} if live else {}
        best = bias
        for i in sorted(most, key=most.__getitem__, reverse=True):
            line, tokens = lines[i], found[i]
            if most[i] + bias + ROUNDING > best:
                parts = _SENTENCE.split(line)
                for part in [tokens] if len(parts) == 1 else map(find, parts):
                    best = max(best, sum([known[t] for t in part]) + bias)
                # what is quoted counts by itself, not with the code around it
                if most[i] + bias > THRESHOLD and ('"' in line or "`" in line):
                    for part in _QUOTE.split(line):
                        best = max(best, sum([known[t] for t in find(part)]) + bias)
            if i - 1 in most and most[i - 1] + most[i] + bias + ROUNDING > best and _COMMENT.match(line) and _COMMENT.match(lines[i - 1]):
                before, whole = sum([known[t] for t in found[i - 1]]), sum([known[t] for t in tokens])
                if before > 0 and whole > 0:
                    best = max(best, before + whole + bias)
        return best


def fit(sentences: list[tuple[str, int]], landmarks: list[str] | None = None) -> AbuseModel:
    """A linear machine with hinge loss on Nyström features; equal sentences share a row and are visited as often as they come."""
    times = Counter(sentences)
    sentences, visits = list(times), np.repeat(np.arange(len(times)), list(times.values()))
    split = [[p for r in _RAW.findall(s) for w in plain_words(r) for p in disjoint(w)] for s, _ in sentences]
    vocabulary = sorted({w for ws in split for w in ws})
    if landmarks is None:
        landmarks = sorted({w for s, _ in made_sentences() for r in _RAW.findall(s) for w in plain_words(r) if 1 < len(w) <= LONGEST_WORD})
    kernel = WordKernel(landmarks)
    rows = kernel.rows(vocabulary)
    at = {w: i for i, w in enumerate(vocabulary)}
    gram = kernel.rows(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-3 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    mapped = rows @ nystrom.astype(np.float32)
    del rows
    x = np.zeros((len(split), mapped.shape[1]), np.float32)
    for i, ws in enumerate(split):
        x[i] = mapped[[at[w] for w in ws]].sum(0)
    y = np.array([1.0 if label else -1.0 for _, label in sentences])
    rng = np.random.default_rng(SEED)
    # a fixed bias: no words at all are as clean as can be
    w, bias, total, seen = np.zeros(x.shape[1]), -1.0, np.zeros(x.shape[1]), 0
    step = 0
    for epoch in range(ROUNDS):
        for i in visits[rng.permutation(len(visits))]:
            step += 1
            rate = 1 / (REGULAR * (step + 2000))
            w *= 1 - rate * REGULAR
            if y[i] * (x[i] @ w + bias) < 1:
                rate = min(rate, 0.5)
                w += rate * y[i] * x[i]
            if epoch >= ROUNDS // 2:
                total += w
                seen += 1
    beta = (nystrom @ (total / seen)).astype(np.float32)
    heavy = np.flatnonzero(np.abs(beta) > LIGHT)  # the rest can't move a word past chance
    return AbuseModel([landmarks[i] for i in heavy], beta[heavy], bias)


_BASE: list[AbuseModel] = []


def base_model() -> AbuseModel:
    """Fitted on the made sentences alone, once per process."""
    if not _BASE:
        _BASE.append(fit(made_sentences()))
    return _BASE[0]


def model_with(extra: list[tuple[str, int]]) -> AbuseModel:
    """Fitted on the made sentences and on ``extra``."""
    return fit(made_sentences() + extra * 3) if extra else base_model()


def labelled_sentences(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> list[tuple[str, int]]:
    """Lines of at most ``limit`` documents that raters agree on; see :func:`worst_lines`."""
    votes = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    agreed = votes.where("low = high").select("doc_id", F.col("low").alias("toxic"))
    chosen = agreed.orderBy(F.xxhash64("doc_id")).limit(limit)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return worst_lines([(r.text, r.toxic) for r in rows])


def worst_lines(rated: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Lines that stand for rated documents: of an abusive one the worst, of a clean one those that the model likes worst.

    Ratings may be wrong: an abusive document without any line near to abuse
    gives none, nor does a clean one's line that is abuse beyond doubt.
    """
    model, out = base_model(), []
    for text, toxic in rated:
        scored = sorted(((model.score(line), line) for line in text.split("\n") if line.strip()), reverse=True)
        if toxic:
            out += [(line, 1) for s, line in scored[:1] if s > DOUBTFUL]
        else:
            out += [(line, 0) for s, line in scored[:CLEAN_LINES] if s < CERTAIN]
    return out


_OWN: list[tuple[tuple, AbuseModel]] = []


def model_of(parts: tuple[list[str], np.ndarray, float]) -> AbuseModel:
    """The model of broadcast weights; tasks of the same job in one process share it, and the words that it has learnt."""
    if not _OWN or _OWN[0][0] is not parts:
        _OWN[:] = [(parts, AbuseModel(*parts))]
    return _OWN[0][1]


def score_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, score, abusive`` of every row; above ``THRESHOLD`` is abusive.

    The score is the worst of the document's lines (and of pairs of comment
    lines). NULL and empty texts have the lowest score, the bias. Repeated rows
    are scored alike; a NULL label or doc_id trains nothing. Map-only; weights
    of some hundred landmarks travel with the task.
    """
    extra = labelled_sentences(docs, labels) if labels is not None else []
    model = model_with(extra)
    shared = docs.sparkSession.sparkContext.broadcast((model.kernel.landmarks, model.beta, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(shared.value)
        for batch in batches:
            scores = np.array([own.score(t) for t in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(scores), pa.array(scores > THRESHOLD)], names=["doc_id", "source", "score", "abusive"]
            )

    return spread(docs.select("doc_id", "source", "text")).mapInArrow(work, "doc_id long, source string, score double, abusive boolean")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where("abusive").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, abusive ones and their rate per source."""
    return (
        p10_scores(spark, sf_dir)
        .groupBy("source")
        .agg(F.count("*").alias("documents"), F.count_if("abusive").alias("abusive"))
        .withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
    )


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
ORACLES: dict[str, str] = {}
