"""What a message asks for, as column expressions over its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that mark a request, as patterns.
PROGRAM = r"(?i)\b(?:programs?|certificates?|certifications?|schools?|diploma|training\s+for|courses?\s+in)\b"
EXPLORING = r"(?i)\bwhat\s+(?:career|job|kind\s+of\s+work|does\s+an?|is\s+an?)\b|\bjob\s+outlook\b|\bbright\s+outlook\b|\brelated\s+occupations\b|\bexplore\s+career|\bwhich\s+career|\bcareer\s+path|degree.to.career"
NATIONWIDE = r"(?i)\bnation\s*-?\s*wide\b"
BROAD = r"(?i)\b(?:entire|whole|all|every)\b"
COUNTRY = r"(?i)\busa\b|\bu\.s\.a\.\b|\bunited\s+states\b|\bu\.s\.\b|\bamerica\b|\bcountry\b|\bnation\b"
FIRST_PERSON = r"(?i)\b(i|i'm|i'd|my|me)\b"
#: Topics in the order they are tried, by the words of a reply.
TOPICS = (
    ("interests", r"what (?:career|kind of work)|career or work goal|field.*interest|healthcare,? trades"),
    ("location", r"where (?:do you|are you)|what (?:city|state|location)|zip code|your location"),
    ("benefits", r"gi bill|vr&e|education benefits|benefit eligibility|benefits.*(?:have|use|left)"),
    ("training", r"degree|certificate|school|training|apprenticeship|on-the-job"),
)


def names_program(message: Column, chosen: Column | None = None) -> Column:
    """Whether a message asks for named programs: it says so, explores no careers, and no occupation is chosen."""
    asked = F.coalesce(message, F.lit(""))
    free = F.lit(True) if chosen is None else chosen.isNull()
    return free & asked.rlike(PROGRAM) & ~asked.rlike(EXPLORING)


def nationwide(message: Column) -> Column:
    """Whether a message asks for the whole country: by one word, or by a broad word and the country's name."""
    asked = F.coalesce(message, F.lit(""))
    return asked.rlike(NATIONWIDE) | (asked.rlike(BROAD) & asked.rlike(COUNTRY))


def topic(reply: Column, topics: tuple[tuple[str, str], ...] = TOPICS, other: str = "general") -> Column:
    """The first topic whose words a reply has."""
    low, out = F.lower(F.coalesce(reply, F.lit(""))), F.lit(other)
    for name, words in reversed(topics):
        out = F.when(low.rlike(words), name).otherwise(out)
    return out


def retained(notes: Column, message: Column, before: Column, after: Column, most: int = 240) -> Column:
    """Notes with the message's first `most` characters, where the profile has not changed, the message
    is in the first person, and no note is the same."""
    note = F.trim(F.coalesce(message, F.lit("")))
    keep = before.eqNullSafe(after) & note.rlike(FIRST_PERSON) & (note != "") & ~F.array_contains(notes, note)
    return F.when(keep, F.array_append(notes, F.substring(note, 1, most))).otherwise(notes)


def overridden(candidates: Column, suggestions: Column, location: Column, saved: Column) -> Column:
    """(suggestions, location) of a turn: where a place is in doubt its candidates are the suggestions,
    and the location goes back to the one saved before."""
    doubt = F.size(F.coalesce(candidates, F.array().cast("array<string>"))) > 0
    return F.struct(F.when(doubt, candidates).otherwise(suggestions).alias("suggestions"), F.when(doubt, saved).otherwise(location).alias("location"))
