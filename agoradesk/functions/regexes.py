"""Character classes and patterns shared by the text operators.

The documents and answers these operators must agree on were produced by a
runtime whose white space includes the Unicode spaces and whose word boundary
is ASCII. Java differs on both, so the classes are spelled out here.
"""

# White space, ASCII word boundary, identifiers.
SPACE = "\\s\\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_SPACE = " \\t\\f\\r\\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
NOT_WORD_AFTER = "(?![A-Za-z0-9_])"
NOT_WORD_BEFORE = "(?<![A-Za-z0-9_])"
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
KEY = "[a-z][a-z0-9_]{2,99}"
