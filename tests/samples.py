"""Rows and a plain matcher that several tests use."""

# title, description, domain, category, feature, recommendation, impact, difficulty,
# prerequisites, configuration, source, notes
PRACTICE_ROWS = [
    (
        1, "Rotate keys", "Rotate them\noften", "Security", 1, 10,
        "Mandatory", "High", "Easy", None, r"path C:\temp", "https://e.org/a", "note a_c",
    ),
    (
        2, "Cache assets", "Étage 100%", "Performance", 2, None,
        "Optional", None, "Bogus", "", None, "HTTPS://e.org", None,
    ),
    (
        3, "Twin", "same", "General", 3, 11,
        "Recommended", "Low", None, "a plan", None, None, "",
    ),
    (
        4, "Twin", "same", "General", 3, 11,
        "Recommended", "Low", "Complex", None, None, "book <1>", None,
    ),
    (
        5, "No shelf", "xabcx", "Security", None, 10,
        "Situational", "Medium", "Medium", None, None, "", "tail\\",
    ),
    (
        6, "Zero", "ÀB", "Security", 0, None,
        None, "Medium", "Easy", None, None, None, None,
    ),
]


def like(text, term):
    """Plain matcher for LIKE '%term%' with ASCII case folding."""
    if text is None:
        return False

    def fold(value):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in value)

    text, pattern = fold(text), "%" + fold(term) + "%"
    reached = {0}
    for char in pattern:
        if char == "%":
            reached = set(range(min(reached), len(text) + 1)) if reached else set()
        else:
            reached = {
                i + 1 for i in reached if i < len(text) and (char == "_" or text[i] == char)
            }
    return len(text) in reached
