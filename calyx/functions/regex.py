"""Regex porting rules: RE2 meaning (the reference's engine) on java.util.regex.

Spark evaluates regexes with java.util.regex, whose defaults differ from RE2
in a few places that change results on real text:

* ``.`` in Java also stops at ``\\r``, U+0085, U+2028/9 -> prefix ``(?d)``
  (UNIX_LINES: only ``\\n`` ends a line, as in RE2);
* ``$`` without ``(?m)`` in Java also matches before a final newline -> ``\\z``;
* ``\\s`` in Java includes the vertical tab -> ``[\\t\\n\\f\\r ]``;
* ``[[:^ascii:]]`` is accepted by Java but means something else ->
  ``[^\\x00-\\x7F]``;
* ``(?P<name>`` is written ``(?<name>`` in Java.

``java_re`` applies these rules to a pattern written for RE2.
"""

from __future__ import annotations

# RE2's \s.
WS = "[\\t\\n\\f\\r ]"
WS_BODY = "\\t\\n\\f\\r "
# Body of a character class with every character Go's unicode.IsSpace
# accepts (used for TrimSpace): ASCII space controls, NEL, NBSP and the
# Unicode space separators.
UNICODE_SPACE = ("\\t\\n\\x0B\\f\\r \\x85\\xA0\\u1680\\u2000-\\u200A"
                 "\\u2028\\u2029\\u202F\\u205F\\u3000")


def java_re(pattern: str) -> str:
    """Translate an RE2 pattern so java.util.regex gives RE2's matches."""
    out = []
    i, n = 0, len(pattern)
    in_class = False
    multiline = False
    flags = ""
    # leading inline flags are kept and extended
    if pattern.startswith("(?") and ")" in pattern[:8]:
        j = pattern.index(")")
        body = pattern[2:j]
        if body and all(ch in "imsU" for ch in body):
            flags = body
            multiline = "m" in body
            i = j + 1
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS_BODY if in_class else WS)
            elif nxt == "S" and not in_class:
                out.append("[^" + WS_BODY + "]")
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if not in_class and pattern.startswith("[[:^ascii:]]", i):
            out.append("[^\\x00-\\x7F]")
            i += len("[[:^ascii:]]")
            continue
        if not in_class and pattern.startswith("[[:ascii:]]", i):
            out.append("[\\x00-\\x7F]")
            i += len("[[:ascii:]]")
            continue
        if not in_class and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            # a ']' right after '[' or '[^' is literal
            if pattern.startswith("^]", i + 1):
                out.append("^]")
                i += 3
                continue
            if pattern.startswith("]", i + 1):
                out.append("]")
                i += 2
                continue
            i += 1
            continue
        if ch == "]" and in_class:
            in_class = False
        elif ch == "$" and not in_class and not multiline:
            out.append("\\z")
            i += 1
            continue
        out.append(ch)
        i += 1
    fl = "d" + flags.replace("U", "")
    if "i" in fl:
        fl += "u"
    return f"(?{fl})" + "".join(out)
