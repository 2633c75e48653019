"""Whether the body of a JavaScript regular expression is valid under its flags (ECMAScript patterns with Annex B).

One pass with a stack of groups, so nesting has no limit. Groups with the same name are an error where they could both take
part in one match, that is, in one alternative.
"""

from __future__ import annotations

import re

import regex

_GROUP = re.compile(r"\?(?:(?P<plain>:)|(?P<ahead>[=!])|(?P<behind><[=!])|<(?P<name>[^\W\d$][\w$‌‍]*|\$[\w$]*)>|(?P<mods>[ims]*(?:-[ims]*)?):)")
_NAME = re.compile(r"\(\?<(?![=!])((?:[^\W\d]|\$)[\w$‌‍]*)>")
_COUNT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")
_HEX = re.compile(r"[0-9a-fA-F]")

#: General_Category values and binary properties that \p{...} may name (fixed values of the language).
CATEGORIES = frozenset(
    "Cased_Letter LC Close_Punctuation Pe Connector_Punctuation Pc Control Cc cntrl Currency_Symbol Sc Dash_Punctuation Pd Decimal_Number Nd digit Enclosing_Mark Me Final_Punctuation Pf Format Cf "
    "Initial_Punctuation Pi Letter L Letter_Number Nl Line_Separator Zl Lowercase_Letter Ll Mark M Combining_Mark Math_Symbol Sm Modifier_Letter Lm Modifier_Symbol Sk Nonspacing_Mark Mn Number N "
    "Open_Punctuation Ps Other C Other_Letter Lo Other_Number No Other_Punctuation Po Other_Symbol So Paragraph_Separator Zp Private_Use Co Punctuation P punct Separator Z Space_Separator Zs "
    "Spacing_Mark Mc Surrogate Cs Symbol S Titlecase_Letter Lt Unassigned Cn Uppercase_Letter Lu".split()
)
BINARY = frozenset(
    "ASCII ASCII_Hex_Digit AHex Alphabetic Alpha Any Assigned Bidi_Control Bidi_C Bidi_Mirrored Bidi_M Case_Ignorable CI Cased Changes_When_Casefolded CWCF Changes_When_Casemapped CWCM "
    "Changes_When_Lowercased CWL Changes_When_NFKC_Casefolded CWKCF Changes_When_Titlecased CWT Changes_When_Uppercased CWU Dash Default_Ignorable_Code_Point DI Deprecated Dep Diacritic Dia Emoji "
    "Emoji_Component EComp Emoji_Modifier EMod Emoji_Modifier_Base EBase Emoji_Presentation EPres Extended_Pictographic ExtPict Extender Ext Grapheme_Base Gr_Base Grapheme_Extend Gr_Ext Hex_Digit Hex "
    "IDS_Binary_Operator IDSB IDS_Trinary_Operator IDST ID_Continue IDC ID_Start IDS Ideographic Ideo Join_Control Join_C Logical_Order_Exception LOE Lowercase Lower Math Noncharacter_Code_Point NChar "
    "Pattern_Syntax Pat_Syn Pattern_White_Space Pat_WS Quotation_Mark QMark Radical Regional_Indicator RI Sentence_Terminal STerm Soft_Dotted SD Terminal_Punctuation Term Unified_Ideograph UIdeo "
    "Uppercase Upper Variation_Selector VS White_Space space XID_Continue XIDC XID_Start XIDS".split()
)
#: Properties of strings, under the flag v only (fixed values of the language).
STRINGS = frozenset("Basic_Emoji Emoji_Keycap_Sequence RGI_Modifier_Sequence RGI_Flag_Sequence RGI_Emoji RGI_Emoji_Modifier_Sequence RGI_Emoji_Tag_Sequence RGI_Emoji_Flag_Sequence RGI_Emoji_ZWJ_Sequence".split())


def _property(text: str, v: bool) -> bool:
    name, eq, value = text.partition("=")
    if not eq:
        return name in CATEGORIES or name in BINARY or v and name in STRINGS
    if name in ("General_Category", "gc"):
        return value in CATEGORIES
    if name not in ("Script", "sc", "Script_Extensions", "scx") or not re.fullmatch(r"[A-Z][a-z]+(?:_[A-Za-z][a-z]*)*", value):
        return False
    try:
        regex.compile(rf"\p{{Script={value}}}")
        return True
    except regex.error:
        return False


class _Bad(Exception):
    pass


class _Pattern:
    def __init__(self, body: str, flags: str) -> None:
        self.s, self.u, self.v = body, "u" in flags or "v" in flags, "v" in flags
        bare = re.sub(r"\\.", "xx", body, flags=re.S)
        bare = re.sub(r"\[[^\]]*\]", lambda m: "x" * len(m[0]), bare)
        self.names = {m[1] for m in _NAME.finditer(bare)}
        self.groups = len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))

    def escape(self, i: int, in_class: bool) -> tuple[int, int | None]:
        """(end, code point or None for a set or an assertion) of the escape whose backslash is at ``i``."""
        s = self.s
        c = s[i + 1 : i + 2]
        if not c:
            raise _Bad
        if c in "dDsSwW":
            return i + 2, None
        if c in "pP" and self.u:
            end = s.find("}", i)
            if s[i + 2 : i + 3] != "{" or end < 0 or not _property(s[i + 3 : end], self.v and c == "p"):
                raise _Bad
            return end + 1, None
        if c in "tnvfr":
            return i + 2, ord({"t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r"}[c])
        if c == "b" and in_class:
            return i + 2, 8
        if c == "u":
            if m := re.compile(r"\{([0-9a-fA-F]+)\}").match(s, i + 2):
                if self.u:
                    if int(m[1], 16) > 0x10FFFF:
                        raise _Bad
                    return m.end(), int(m[1], 16)
            if m := re.compile(r"[0-9a-fA-F]{4}").match(s, i + 2):
                high = int(m[0], 16)
                low = re.compile(r"\\u([dD][c-fC-F][0-9a-fA-F]{2})").match(s, m.end())
                if self.u and 0xD800 <= high < 0xDC00 and low:
                    return low.end(), 0x10000 + ((high - 0xD800) << 10) + int(low[1], 16) - 0xDC00
                return m.end(), high
            if self.u:
                raise _Bad
            return i + 2, ord("u")
        if c == "x":
            if m := re.compile(r"[0-9a-fA-F]{2}").match(s, i + 2):
                return m.end(), int(m[0], 16)
            if self.u:
                raise _Bad
            return i + 2, ord("x")
        if c == "c":
            n = s[i + 2 : i + 3]
            if n.isascii() and n.isalpha():
                return i + 3, ord(n) % 32
            if self.u:
                raise _Bad
            return i + 1, ord("\\")
        if c == "k" and not in_class and (self.u or self.names):
            m = re.compile(r"<([^>]*)>").match(s, i + 2)
            if not m or m[1] not in self.names:
                raise _Bad
            return m.end(), None
        if c.isdigit() and c.isascii():
            if c == "0" and not s[i + 2 : i + 3].isdigit():
                return i + 2, 0
            m = re.compile(r"\d+").match(s, i + 1)
            if self.u:
                if in_class or c == "0" or int(m[0]) > self.groups:
                    raise _Bad
                return m.end(), None
            octal = re.compile(r"[0-3][0-7]{0,2}|[4-7][0-7]?").match(s, i + 1)
            return (octal.end(), int(octal[0], 8)) if octal else (i + 2, ord(c))
        if self.u and c not in "^$\\.*+?()[]{}|/" and not (in_class and (c == "-" or self.v and c in "&!#%,:;<=>@`~")):
            raise _Bad
        return i + 2, ord(c)

    def char_class(self, i: int) -> int:
        """End of the class whose bracket is at ``i``."""
        s = self.s
        i += 1
        i += s[i : i + 1] == "^"
        if self.v:
            return self._set_class(i)
        before: int | None = None
        ready = dash = False
        while i < len(s) and s[i] != "]":
            if s[i] == "\\":
                i, code = self.escape(i, True)
            else:
                code = ord(s[i])
                i += 1
                if code == 45 and ready and not dash and s[i : i + 1] != "]":
                    dash = True
                    continue
            if dash:
                if before is None or code is None:
                    if self.u:
                        raise _Bad
                elif before > code:
                    raise _Bad
                ready = dash = False
            else:
                before, ready = code, True
        if i >= len(s):
            raise _Bad
        return i + 1

    def _set_class(self, i: int) -> int:
        s, depth = self.s, 1
        before: int | None = None
        while i < len(s):
            c = s[i]
            if c == "]":
                depth -= 1
                i += 1
                if not depth:
                    return i
                before = None
            elif c == "[":
                depth += 1
                i += 1 + (s[i + 1 : i + 2] == "^")
                before = None
            elif s.startswith(("--", "&&"), i):
                i += 2
                before = None
            elif c == "-":
                i += 1
                if before is None or i >= len(s) or s[i] in "[]":
                    raise _Bad
                i, code = self.escape(i, True) if s[i] == "\\" else (i + 1, ord(s[i]))
                if code is None or before > code:
                    raise _Bad
                before = None
            elif c == "\\":
                if s.startswith("\\q{", i):
                    i, before = s.find("}", i) + 1, None
                    if not i:
                        raise _Bad
                else:
                    i, before = self.escape(i, True)
            elif c in "(){}/|" or c in "!#$%*+,.:;<=>?@^`~" and s[i + 1 : i + 2] == c:
                raise _Bad
            else:
                before, i = ord(c), i + 1
        raise _Bad

    def check(self) -> None:
        s, i = self.s, 0
        #: per open group: how it ends (may a quantifier follow), names of its alternative, names of those before
        stack: list[list] = [[True, set(), set()]]
        operand = False
        while i < len(s):
            c = s[i]
            if c == "(":
                i += 1
                quantifiable = True
                name = None
                if s[i : i + 1] == "?":
                    m = _GROUP.match(s, i)
                    if not m or m["mods"] is not None and (m["mods"] in ("", "-") or len(set(m["mods"].replace("-", ""))) != len(m["mods"].replace("-", ""))):
                        raise _Bad
                    quantifiable = not (m["behind"] or m["ahead"] and self.u)
                    name = m["name"]
                    i = m.end()
                if name:
                    if any(name in f[1] for f in stack):
                        raise _Bad
                    stack[-1][1].add(name)
                stack.append([quantifiable, set(), set()])
                operand = False
                continue
            if c == ")":
                if len(stack) == 1:
                    raise _Bad
                operand, now, before = stack.pop()
                stack[-1][1].update(now, before)
            elif c == "|":
                stack[-1][2] |= stack[-1][1]
                stack[-1][1] = set()
                operand = False
            elif c in "^$":
                operand = False
            elif c in "*+?":
                if not operand:
                    raise _Bad
                i += s[i + 1 : i + 2] == "?"
                operand = False
            elif c == "{":
                m = _COUNT.match(s, i)
                if m:
                    if not operand or m[3] and int(m[3]) < int(m[1]):
                        raise _Bad
                    i = m.end() - 1
                    i += s[i + 1 : i + 2] == "?"
                    operand = False
                elif self.u:
                    raise _Bad
                else:
                    operand = True
            elif c in "]}" and self.u:
                raise _Bad
            elif c == "[":
                i = self.char_class(i)
                operand = True
                continue
            elif c == "\\":
                if s[i + 1 : i + 2] in ("b", "B"):
                    i, operand = i + 2, False
                else:
                    i, operand = self.escape(i, False)[0], True
                continue
            else:
                operand = True
            i += 1
        if len(stack) > 1:
            raise _Bad


def regex_ok(body: str, flags: str) -> bool:
    if len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy") or {"u", "v"} <= set(flags):
        return False
    try:
        _Pattern(body, flags).check()
        return True
    except _Bad:
        return False
