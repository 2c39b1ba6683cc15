"""Character classes shared by the text and URL expressions.

Java needs ``(?U)`` for Unicode ``\\s``/``\\d``/``\\b``; its whitespace class still leaves out
U+001C..U+001F, which count as whitespace here.
"""

SPACE = r"\s\x1c-\x1f"

# Characters with a digit value outside the decimal-number category (superscripts, subscripts,
# circled and similar digits).
OTHER_DIGITS = (
    r"\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
    r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
    r"\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
DIGIT = r"\p{Nd}" + OTHER_DIGITS
LETTER = r"\p{L}"
ALNUM = r"\p{L}\p{N}"
CONSONANT_RUN = r"[\p{L}&&[^aeiouAEIOU]]+"
