"""Texts to token classes, one function per language.

Each scans with one compiled pattern and looks a token's class up by its
spelling; spellings repeat, so most tokens cost one dictionary access.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Spellings a lexer remembers before it starts afresh.
KNOWN = 300_000
SKIP = ""
_DQ = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
_SQ = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_TQ = r'"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""'
_TS = r"'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"
_WORD = r"[^\W\d][\w$]*+"
_C_COMMENT = r"//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
_C_NUM = r"(?:0[xXbBoO][\da-fA-F_]++[nlLuU]?|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eEpP][+-]?\d++)?[nlLfFdDi]?)(?![\w$])"


class Lexer:
    def __init__(self, pattern: str, words: set[str], signs: dict[str, str], comment: tuple[str, ...]):
        self.find = re.compile(pattern).findall
        self.words, self.signs, self.comment = words, signs, comment
        self.known: dict[str, str] = {}

    def class_of(self, tok: str) -> str:
        """Class of a spelling not met yet."""
        c = self.signs.get(tok)
        if c is None:
            first = tok[0]
            if tok.startswith(self.comment):
                c = SKIP
            elif tok in self.words:
                c = tok
            elif first.isalpha() or first in "_$":
                c = "STR" if tok[-1] in "\"'" else "ID"
            elif len(tok) > 1 and first in "\"'":
                c = "STR"
            elif len(tok) > 1 and first == "`":
                c = "TPL"
            elif first.isdigit() or (first == "." and len(tok) > 1):
                c = "NUM" if len(tok) > 1 or tok.isascii() else "BAD"
            elif "/" in tok and len(tok.strip()) > 2:
                c = "RE"
            else:
                c = "BAD"
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known[tok] = c
        return c


def _signs(ops: str, **classes: str) -> dict[str, str]:
    """Every sign stands for itself unless a class lists it; ``ops`` are OP."""
    out = {s: "OP" for s in ops.split()}
    for cls, signs in classes.items():
        for s in signs.split():
            out[s] = s if cls == "SELF" else cls
    return out


def _alternatives(signs: dict[str, str]) -> str:
    return "|".join(re.escape(s) for s in sorted(signs, key=lambda s: (-len(s), s)))


def keywords(grammar: str) -> set[str]:
    return set(re.findall(r"'([A-Za-z]\w*)'", grammar))


# -- scripts with statement ends at line ends ---------------------------------

_ENDS = frozenset("ID NUM STR TPL RE KV ) ] } INC NOT break continue return debugger of as from type get set async static super default yield let".split())
_CONTINUES = frozenset(". ?. , ; ) ] ? : OP = ASG * < > SGN ( [ { => TPL instanceof in else catch finally as satisfies".split())


def script(grammar: str) -> Callable[[str], list[str]]:
    signs = _signs(
        "== != === !== <= >= >> >>> && || ?? ** / % | & ^ << ++",
        ASG="+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=",
        SGN="+ -", NOT="! ~", INC="++ --", SELF="( ) [ ] { } ; , . ?. : ? => ... = < > * @ #",
    )
    if "'interface'" in grammar:  # generics end in single signs
        for s in (">>", ">>>", ">=", ">>=", ">>>="):
            signs.pop(s)
        signs[">="] = "OP"
    template = r"`[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})[^`\\$]*+)*+`"
    regex_lit = r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    pattern = (
        rf"\$[\w$]*+|{_WORD}|\n|(?<=[(,=:\[!&|?{{}};+~^%*\n-])[ \t]*{regex_lit}|(?<=return)[ \t]+{regex_lit}|(?<==>)[ \t]*{regex_lit}"
        rf"|{_C_COMMENT}|{_DQ}|{_SQ}|{template}|{_C_NUM}|{_alternatives(signs)}|[^\s]"
    )
    lex = Lexer(pattern, keywords(grammar), signs | {"\n": "NL", "this": "KV", "true": "KV", "false": "KV", "null": "KV"}, ("//", "/*"))

    def classes(text: str) -> list[str]:
        if text.startswith("#!"):
            text = text[text.find("\n") :] if "\n" in text else ""
        known, out, stack = lex.known, [], ["{"]
        prev, line_end = "", False
        for tok in lex.find(text):
            c = known.get(tok)
            if c is None:
                c = lex.class_of(tok)
            if c == "NL":
                line_end = True
                continue
            if not c:
                if "\n" in tok:
                    line_end = True
                continue
            if line_end:
                line_end = False
                if prev in _ENDS and c not in _CONTINUES and stack[-1] == "{":
                    out.append("NL")
            if c in "([{":
                stack.append(c)
            elif c in ")]}" and len(stack) > 1:
                stack.pop()
            out.append(c)
            prev = c
        if prev != ";":
            out.append("NL")
        return out

    return classes


def go(grammar: str) -> Callable[[str], list[str]]:
    signs = _signs(
        "== != <= >= >> << && || / % | ^ &^ ~", ASG="+= -= *= /= %= <<= >>= &= |= ^= &^=", SGN="+ -", NOT="!", INC="++ --",
        SELF="( ) [ ] { } ; , . : ... = := < > * & <-",
    )
    pattern = rf"{_WORD}|\n|{_C_COMMENT}|{_DQ}|`[^`]*+`|'(?:[^'\\\n]|\\.[^'\n]*)'|{_C_NUM}|{_alternatives(signs)}|[^\s]"
    lex = Lexer(pattern, keywords(grammar), signs | {"\n": "NL"}, ("//", "/*"))
    ends = frozenset("ID NUM STR ) ] } INC return break continue fallthrough".split())

    def classes(text: str) -> list[str]:
        known, out, prev = lex.known, [], ""
        for tok in lex.find(text):
            c = known.get(tok)
            if c is None:
                c = lex.class_of(tok)
                if c == "TPL":
                    c = known[tok] = "STR"
            if c == "NL" or (not c and "\n" in tok):
                if prev in ends:
                    out.append(";")
                    prev = ";"
            elif c:
                out.append(c)
                prev = c
        if prev in ends:
            out.append(";")
        return out

    return classes


def _plain(lex: Lexer) -> Callable[[str], list[str]]:
    """For languages in which line ends mean nothing."""

    def classes(text: str) -> list[str]:
        known, out = lex.known, []
        for tok in lex.find(text):
            c = known.get(tok)
            if c is None:
                c = lex.class_of(tok)
            if c:
                out.append(c)
        return out

    return classes


def java(grammar: str) -> Callable[[str], list[str]]:
    signs = _signs(
        "== != <= && || / % | ^ << ~", ASG="+= -= *= /= %= <<= &= |= ^=", SGN="+ -", NOT="! ~", INC="++ --",
        SELF="( ) [ ] { } ; , . : ? ... = < > * & -> :: @",
    )
    signs[">="] = "OP"
    pattern = rf"{_WORD}|{_C_COMMENT}|{_TQ}|{_DQ}|'(?:[^'\\\n]|\\.[^'\n]*)'|{_C_NUM}|{_alternatives(signs)}|[^\s]"
    extra = dict.fromkeys("public private protected abstract native transient volatile strictfp".split(), "MOD")
    extra |= dict.fromkeys("true false null".split(), "KV")
    return _plain(Lexer(pattern, keywords(grammar) - {"record", "sealed", "permits", "yield"} | {"record"}, signs | extra, ("//", "/*")))


def json(grammar: str) -> Callable[[str], list[str]]:
    string = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*+"'
    number = r"-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?(?![\w.+-])"
    signs = _signs("", SELF="{ } [ ] : ,") | dict.fromkeys(["true", "false", "null"], "LIT")
    lex = Lexer(rf"{string}|{number}|{_WORD}|[^ \t\r\n]", set(), signs, ("\0",))
    plain = lex.class_of

    def class_of(tok: str) -> str:
        c = plain(tok)
        if tok[0] == "-" and len(tok) > 1:
            c = "NUM"
        lex.known[tok] = c
        return c

    lex.class_of = class_of  # type: ignore[method-assign]
    return _plain(lex)


def sql(grammar: str) -> Callable[[str], list[str]]:
    signs = _signs(
        "<> != <= >= < > || / % | & ^ << >> == -> ->> #> #>> @> <@ ~ ~* !~ := =>", SGN="+ -", NOT="!", SELF="( ) [ ] ; , . = * ::"
    )
    signs["?"] = "PARAM"
    dollar = r"\$(\w*)\$"
    pattern = (
        rf"(?:--[^\n]*+|{_C_COMMENT.replace('//[^\n]*+|', '')})|[eEnNxXbB]?'[^'\\]*+(?:(?:''|\\[\s\S])[^'\\]*+)*+'|\"[^\"\n]++\"|`[^`\n]++`|\$\w*\$[\s\S]*?\$\w*\$"
        rf"|{_WORD}|[:@]{_WORD}|\$\d++|%s|(?:\d++\.?\d*+|\.\d++)(?:[eE][+-]?\d++)?(?![\w$])|{_alternatives(signs)}|[^\s]"
    )
    assert dollar
    words = keywords(grammar)
    lex = Lexer(pattern, words, signs, ("--", "/*"))
    plain = lex.class_of

    def class_of(tok: str) -> str:
        up = tok.upper()
        if tok[0] in "\"`" and len(tok) > 1:
            c = "ID"
        elif tok[0] == "'" and len(tok) > 1 or (len(tok) > 2 and tok[-1] == "'"):
            c = "STR"
        elif up == "CAST":
            c = "CAST"
        elif up in words:
            c = up
        elif tok[0] == "$" and len(tok) > 1 or tok == "%s" or (tok[0] in ":@" and len(tok) > 1 and tok[1].isalpha()):
            c = "PARAM" if tok[-1] != "$" else "STR"
        else:
            c = plain(tok)
        lex.known[tok] = c
        return c

    lex.class_of = class_of  # type: ignore[method-assign]
    return _plain(lex)


def python(grammar: str) -> Callable[[str], list[str]]:
    signs = _signs(
        "// % | & ^ << >>", ASG="+= -= *= /= //= %= **= <<= >>= &= |= ^= @=", CMP="== != <= >=", SGN="+ -", NOT="~",
        SELF="( ) [ ] { } ; , . : ... = := < > * ** @ -> /",
    )
    digits = r"\d(?:_?\d)*+"
    number = rf"(?:0[xX](?:_?[\da-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++|(?:{digits}\.(?:{digits})?|\.{digits})(?:[eE][+-]?{digits})?[jJ]?|{digits}(?:[eE][+-]?{digits}[jJ]?|[jJ])|0(?:_?0)*+(?![\d_])|[1-9](?:_?\d)*+)(?!\w)"
    prefix = r"(?:[rRbBfFuU]|[rR][bB]|[bB][rR]|[fF][rR]|[rR][fF])?"
    pattern = (
        rf"[^\W\d]\w*+(?![\"'])|\n(?:[ \t\f]*+(?:\#[^\n]*+)?\n)*+[ \t\f]*+|\#[^\n]*+|{prefix}(?:{_TQ}|{_TS}|{_DQ}|{_SQ})"
        rf"|[^\W\d]\w*+|{number}|\\\n|{_alternatives(signs)}|[^\s]"
    )
    lex = Lexer(pattern, keywords(grammar), signs | {"\\\n": SKIP}, ("#",))
    empty_quotes = frozenset(('"', "'"))

    def classes(text: str) -> list[str]:
        known, out, stack = lex.known, [], [0]
        narrow = [0]  # the same indents with tabs of one column: both must agree
        depth, pending, thin = 0, -1, 0
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        for tok in lex.find("\n" + text):
            if tok[0] == "\n":
                if not depth:
                    tail = tok[tok.rfind("\n") + 1 :]
                    thin = len(tail)
                    pending = len(tail.expandtabs(8)) if "\t" in tail else thin
                continue
            c = known.get(tok)
            if c is None:
                c = lex.class_of(tok)
                if c == "ID" and tok in empty_quotes:
                    c = "BAD"
            if not c:
                continue
            if pending >= 0:
                if out:
                    out.append("NL")
                if pending > stack[-1]:
                    out.append("INDENT" if thin > narrow[-1] else "BAD")
                    stack.append(pending)
                    narrow.append(thin)
                else:
                    while pending < stack[-1]:
                        stack.pop()
                        narrow.pop()
                        out.append("DEDENT")
                    if pending != stack[-1] or thin != narrow[-1]:
                        out.append("BAD")
                pending = -1
                if c == "ID" and tok in ("match", "case", "type"):
                    out.append(tok.upper() + "?")
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(0, depth - 1)
            out.append(c)
        if out:
            out.append("NL")
        out.extend(["DEDENT"] * (len(stack) - 1))
        return _soft(out)

    return classes


def _soft(classes: list[str]) -> list[str]:
    """``match``, ``case`` and ``type`` at a line's start are keywords where what follows makes them so.

    The first two where their line ends in a colon, ``type`` before a name and ``=`` or type parameters.
    """
    if not {"MATCH?", "CASE?", "TYPE?"} & set(classes):
        return classes
    out, i = [], 0
    while i < len(classes):
        c = classes[i]
        if c == "TYPE?":
            if classes[i + 2 : i + 3] == ["ID"] and classes[i + 3 : i + 4] in (["="], ["["]):
                out.append("TYPE")
                i += 1
            i += 1
            continue
        if c in ("MATCH?", "CASE?"):
            j, depth = i + 1, 0
            while j < len(classes) and not (classes[j] in ("NL", ":") and depth == 0 and j > i + 2):
                depth += (classes[j] in ("(", "[", "{")) - (classes[j] in (")", "]", "}"))
                j += 1
            soft = classes[i + 2 : i + 3] not in ([":"], ["="], ["."], [","], ["NL"], ["ASG"]) and j < len(classes) and classes[j] == ":"
            if soft:
                out.append(c[:-1])
                i += 2
                continue
            i += 1
            continue
        out.append(c)
        i += 1
    return out


# -- YAML ---------------------------------------------------------------------

_Y_QUOTED = r'"(?:[^"\\]|\\[\s\S])*+"|\'(?:[^\']|\'\')*+\''
_Y_KEY = re.compile(rf"((?:[&!]\S+[ ]+)*)(?:({_Y_QUOTED})|(\*\S+)|((?:[^\s\-?:,\[\]{{}}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^\n:#]|:(?=\S)|(?<=\S)\#)*?))[ \t]*:(?=[ \t\n]|$)")
_Y_BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:(?<=[ \t])\#.*)?$")
_Y_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^\n:#]|:(?=\S)|(?<=\S)#)*")
_Y_FLOW = re.compile(rf"[\[\]{{}},]|{_Y_QUOTED}|:(?=[\s,\[\]{{}}]|$)|(?<=\"):|(?<=[ \n])\#[^\n]*|[*&!][^\s,\[\]{{}}]*|(?:[^\s\-?:,\[\]{{}}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{{}}]))(?:[^\n:#,\[\]{{}}]|:(?=[^\s,\[\]{{}}])|(?<=\S)\#)*|\S")
_Y_REST = re.compile(r"[ \t]*(?:(?:^|(?<=[ \t]))\#[^\n]*)?$")


def yaml(grammar: str) -> Callable[[str], list[str]]:
    def flow(text: str, at: int, out: list[str]) -> int:
        """Tokens of a flow collection that starts at ``at``; where it ends."""
        depth = 0
        for m in _Y_FLOW.finditer(text, at):
            t = m.group()
            if t in "[{":
                depth += 1
                out.append(t)
            elif t in "]}":
                depth -= 1
                out.append(t)
                if depth <= 0:
                    return m.end()
            elif t in ",:":
                out.append(t)
            elif t[0] == "#" and len(t) >= 1:
                continue
            elif t[0] in "\"'":
                out.append("QUOTED" if len(t) > 1 else "BAD")
            elif t[0] == "*":
                out.append("ALIAS")
            elif t[0] in "&!":
                out.append("TAG")
            elif _Y_PLAIN.match(t):
                if out[-1] != "PLAIN":  # a plain text may run over lines
                    out.append("PLAIN")
            else:
                out.append("BAD")
        return len(text)

    def classes(text: str) -> list[str]:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        out: list[str] = []
        stack = [0]
        at, n = 0, len(text)
        while at < n:
            end = text.find("\n", at)
            end = n if end < 0 else end
            line = text[at:end]
            body = line.lstrip(" ")
            if not body.strip() or body[0] == "#":
                at = end + 1
                continue
            col = len(line) - len(body)
            if col == 0 and (line.startswith(("---", "...")) and (len(line) == 3 or line[3] in " \t") or line[0] == "%"):
                out.extend(["DEDENT"] * (len(stack) - 1))
                stack = [0]
                out.append("SEP")
                if line[0] == "%" or not line[3:].strip() or line[3:].strip()[0] == "#":
                    at = end + 1
                    continue
                col += 4
                body = line[4:]
            else:
                if body[0] == "\t":
                    out.append("BAD")
                if col > stack[-1]:
                    stack.append(col)
                    out.append("INDENT")
                else:
                    while col < stack[-1]:
                        stack.pop()
                        out.append("DEDENT")
                    if col > stack[-1]:
                        out.append("BAD")
            pos = at + col
            outer = stack[-1]
            key_done = False
            while True:
                m = re.compile(r"[ \t]*").match(text, pos, end)
                pos = m.end()
                rest = text[pos:end]
                if not rest or (rest[0] == "#" and pos > at):
                    out.append("NL")
                    at = end + 1
                    break
                if rest == "-" or rest.startswith("- "):
                    out.append("BAD" if key_done else "-")
                    pos += 1
                    inner = rest[1:].lstrip(" ")
                    if inner and inner[0] != "#" and (inner == "-" or inner.startswith("- ") or _Y_KEY.match(inner)) and inner[0] not in "{[":
                        stack.append(pos - at + len(rest) - 1 - len(inner))
                        out.append("INDENT")
                        outer = stack[-1]
                    continue
                if not key_done and (m := _Y_KEY.match(text, pos)) and m.end() <= end and rest[0] not in "{[":
                    if m[1]:
                        out.append("TAG")
                    out.extend(["QUOTED" if m[2] else "ALIAS" if m[3] else "PLAIN", ":"])
                    pos = m.end()
                    key_done = True
                    continue
                if rest[0] in "&!":
                    out.append("TAG")
                    pos += len(re.match(r"\S+", rest).group())
                    continue
                if rest[0] in "|>":
                    out.append("BLOCK" if _Y_BLOCK.match(rest) else "BAD")
                    at = end + 1
                    floor = outer if key_done or len(stack) > 1 else -1
                    while at < n:
                        end = text.find("\n", at)
                        end = n if end < 0 else end
                        line = text[at:end]
                        if line.strip() and len(line) - len(line.lstrip(" ")) <= floor:
                            break
                        at = end + 1
                    break
                if rest[0] in "{[":
                    stop = flow(text, pos, out)
                    end = text.find("\n", stop)
                    end = n if end < 0 else end
                    tail = text[stop:end].strip()
                    if tail and tail[0] == ":":
                        out.append(":")
                        pos = stop + text[stop:end].index(":") + 1
                        key_done = True
                        continue
                    out.append("NL" if not tail or tail[0] == "#" else "BAD")
                    at = end + 1
                    break
                if rest[0] in "\"'":
                    q = re.compile(_Y_QUOTED).match(text, pos)
                    if not q:
                        out.append("BAD")
                        at = n
                        break
                    out.append("QUOTED")
                    end = text.find("\n", q.end())
                    end = n if end < 0 else end
                    tail = text[q.end() : end].strip()
                    out.append("NL" if not tail or tail[0] == "#" else "BAD")
                    at = end + 1
                    break
                if rest[0] == "*":
                    out.extend(["ALIAS", "NL"])
                    at = end + 1
                    break
                p = _Y_PLAIN.match(text, pos, end)
                tail = text[p.end() : end].strip() if p else "x"
                out.extend(["PLAIN" if p else "BAD", "NL" if not tail or tail[0] == "#" else "BAD"])
                at = end + 1
                break
        out.extend(["DEDENT"] * (len(stack) - 1))
        return out

    return classes
