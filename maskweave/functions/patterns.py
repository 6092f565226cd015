"""Fixed detection patterns and lookup values.

Fixed values: these patterns, limits and bounds decide which characters count as private,
so they are kept exactly as the detection contract states them.
"""

# Inline flag U gives Unicode-aware \w, \d, \s and \b.
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
CARD = r"(?U)\b(?:\d[ -]?){12,18}\d\b"
IP = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
PHONE = r"(?U)\+?\d[\d\s().-]{6,}\d"

# EMAIL again, for the JVM matcher: a match can only begin where a run of local-part
# characters begins, or where the previous match ended (\G).  Finds the same matches as
# EMAIL, but a long run without '@' costs one pass instead of one pass per character.
EMAIL_LINEAR = r"(?U)(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]++\.[\w.-]+"

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
PLACEHOLDER = r"<<([^<>]*)>>"

# Possessive where nothing follows that a shorter run would allow: same words, no recursion.
WORD = (
    r"(?iuU)(?:https?://[^\s]+|www\.[^\s]+)"
    r"|(?-uU:[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,})"
    r"|(?-uU:@[a-z0-9_]+)"
    r"|\w++(?:[-_]\w++)*+"
    r"|\S"
)

# Latency classes: each counts what took no longer than so many seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]

# So many values of a counter label without a fixed list are told apart; the rest share "other".
LABEL_CAP = 64
# Most recent suggestion candidates kept for review.
SUGGESTION_LIMIT = 200
# Longest partial placeholder held back between two stream chunks, in bytes.
MAX_PENDING = 256
# Largest accepted request body, in bytes.
MAX_BODY_BYTES = 2 * 1024 * 1024
# The scope whose policy entries apply to every request.
GLOBAL_SCOPE = "global"
