"""Word lists, literal tables and patterns that results must agree on."""

# ---- input understanding ----
QUESTION_WORDS = ["what", "why", "how", "define", "explain", "describe", "calculate", "prove"]
MEETING_WORDS = ["agenda", "meeting", "action item", "deadline", "decision", "follow up", "client", "project"]
STUDY_WORDS = ["chapter", "definition", "formula", "exercise", "theorem", "example"]
BUSINESS_WORDS = ["invoice", "amount", "payment", "total", "gst"]

# ---- cleanup and normalization ----
PAGE_NOISE = [r"^page\s*\d+(\s*of\s*\d+)?$", r"^\d+\s*/\s*\d+$", r"^-?\s*\d+\s*-?$", r"^confidential$", r"^draft$", r"^sample copy$"]
CLEANUP_MERGES = {
    "ofthe": "of the", "ofthese": "of these", "ofthis": "of this", "inthe": "in the", "onthe": "on the",
    "tothe": "to the", "forthe": "for the", "andthe": "and the", "withthe": "with the", "fromthe": "from the",
    "bythe": "by the", "atthe": "at the", "wordcell": "word cell", "thingsappear": "things appear",
    "separateunits": "separate units",
}
NORMALIZER_MERGES = {
    "ofa": "of a", "ofthe": "of the", "ofmany": "of many", "ofseparate": "of separate", "wordcell": "word cell",
    "thingsappear": "things appear", "separateunits": "separate units", r"cells\.Cell": "cells. Cell",
    r"tree\.This": "tree. This", r"science\.This": "science. This", r"units\.The": "units. The",
}
DENSE_MARKERS = [
    "PAPER", "MARGINS", "CONTENTS", "FOLLOWING MUST BE STRICTLY FOLLOWED", "NUMBERING", "PREPARATION OF CHAPTERS",
    "SPACING/ALIGNMENT", "SECTION/SUBSECTION NUMBERING", "FIGURES", "TABLES", "BINDING", "NUMBER OF COPIES",
]
GUIDELINE = r"\d{1,2}\s+[A-Z][A-Za-z /&\-]{3,60}\s+[–-]"
ROMAN = "I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII"

# ---- structure ----
NOISE_WORDS = ["page", "copyright", "confidential", "draft", "university", "college", "institute", "www.", "http"]
HEADING_REJECTS = ["font", "spacing", "alignment", "margin", "margins", "numbering", "bottom", "top", "corner", "page number", "times new roman"]
LAYOUT_WORDS = ["table", "figure", "spacing", "paragraph", "alignment"]
TITLE_PATTERNS = [r"^(Chapter|Unit|Section)\s+\d+", r"^[A-Z][A-Z0-9 /:&\-\(\)]{4,80}$", r"^[A-Z][A-Za-z0-9 ,:&\-\(\)]{3,80}$"]
HEADING = r"^((?:Chapter|Unit|Section)\s+\d+[:.\-]?\s+.+|[A-Z][A-Z /&\-]{4,80})$"
NUMBERED_HEADING = r"^\d+\.\s+[A-Z][A-Za-z ,:&\-]{8,80}$"
QUESTION_STARTS = ["what ", "why ", "how ", "define ", "explain ", "describe ", "calculate ", "prove "]
BULLETS = ["-", "•", "*", "–"]
SECTION_LABELS = ["summary", "objective", "definition", "requirement", "action item", "decision", "risk", "table data", "question answer", "example", "conclusion"]
LABEL_RULES = [
    ("action item", ["deadline", "owner", "action"]), ("risk", ["risk", "issue"]), ("question answer", ["?"]),
    ("conclusion", ["conclusion"]), ("objective", ["objective", "purpose"]), ("definition", ["definition", "means"]),
    ("requirement", ["requirement", "must", "shall"]),
]

# ---- chunks ----
HIGH_TERMS = ["abstract", "summary", "objective", "chapter", "question", "definition", "concept", "method", "result", "conclusion", "requirement", "deadline", "action", "experience", "project", "skill", "education"]
MEDIUM_TERMS = ["certificate", "declaration", "contents", "references", "appendix", "figures", "tables"]
LOW_VALUE_KEYS = ["top-left corner", "top-right corner", "bottom-left", "bottom-right", "bottom-center", "corner", "page number"]
LOW_VALUE_PHRASES = ["top-left corner", "top-right corner", "bottom-left", "bottom-right", "bottom-center", "page number"]
PRIORITY = {"layout_section": 80, "roman_item": 55, "table": 95, "paragraph": 40, "plain_text": 30}
PREFERRED = {
    "student": ["numbered_item", "section", "key_value", "layout_section", "paragraph"],
    "professional": ["table", "key_value", "section", "numbered_item", "layout_section", "paragraph"],
    "general": ["section", "paragraph", "numbered_item", "key_value", "layout_section"],
}
BOOST = {
    ("student", "important_notes"): ["definition", "objective", "important", "chapter", "abstract", "key", "rule", "concept"],
    ("student", "revision_sheet"): ["definition", "formula", "key", "important", "objective"],
    ("student", "mcqs"): ["definition", "concept", "objective", "important"],
    ("student", "qa_generation"): ["question", "definition", "explain", "objective"],
    ("student", "flashcards"): ["definition", "term", "concept", "key"],
    ("student", None): ["definition", "important", "objective", "key"],
    ("professional", "action_items"): ["deadline", "owner", "action", "must", "required", "priority"],
    ("professional", "meeting_minutes"): ["agenda", "decision", "action", "deadline", "discussion"],
    ("professional", "executive_summary"): ["objective", "result", "risk", "decision", "summary"],
    ("professional", "structured_report"): ["requirement", "objective", "result", "method", "conclusion"],
    ("professional", None): ["objective", "requirement", "decision", "action"],
    ("general", None): ["important", "summary", "key", "main"],
}
EIGHT_CHUNK_TASKS = {"student": ["important_notes", "revision_sheet", "mcqs", "qa_generation"], "professional": ["structured_report", "meeting_minutes", "action_items"]}

# ---- modes, tasks, formats ----
TASKS = {
    "student": ["important_notes", "qa_generation", "answer_questions", "flashcards", "mcqs", "beginner_explanation", "revision_sheet"],
    "professional": ["executive_summary", "main_points", "action_items", "meeting_minutes", "structured_report", "table_format", "email_draft"],
    "general": ["short_summary", "bullet_summary", "key_points", "simplify", "clean_text"],
}
DEFAULT_TASK = {"student": "important_notes", "professional": "executive_summary", "general": "short_summary"}
STRATEGY = {"student": "educational_generation", "professional": "professional_document_generation", "general": "general_summarization"}
LEGACY_TASK = {"bullet": "bullet_summary", "short": "short_summary", "detailed": "important_notes", "keypoints": "key_points", "beginner": "beginner_explanation", "qa": "qa_generation"}
LEGACY_STUDENT = ["important_notes", "qa_generation", "beginner_explanation"]
OUTPUT_FORMAT = {
    "important_notes": "study_notes", "revision_sheet": "revision_sheet", "flashcards": "flashcards", "mcqs": "mcqs",
    "qa_generation": "question_answers", "short_summary": "summary", "bullet_summary": "bullet_summary",
    "executive_summary": "executive_summary", "meeting_minutes": "meeting_minutes", "action_items": "action_items",
    "structured_report": "structured_report", "table_format": "table", "email_draft": "email",
    "answer_questions": "answers", "beginner_explanation": "beginner_explanation", "main_points": "main_points",
    "key_points": "key_points", "simplify": "simplified_text", "clean_text": "clean_text",
}
TOKEN_BUDGET = {
    "email_draft": 520, "table_format": 800, "action_items": 900, "main_points": 900, "short_summary": 700,
    "bullet_summary": 900, "key_points": 900, "clean_text": 1000, "simplify": 1100, "executive_summary": 1100,
    "meeting_minutes": 1200, "structured_report": 1400, "important_notes": 1400, "beginner_explanation": 1200,
    "revision_sheet": 1400, "qa_generation": 1400, "flashcards": 1200, "mcqs": 1500, "answer_questions": 1200,
}
COMPLEX_FLAGS = ["long document detected: true", "recommended strategy: hierarchical_summary", "free-tier limit applied: true", "only limited chunks were included", "limit applied: true"]
UNFINISHED = [" or", " and", " with", " from", " to", " for", " of", " in", " the", " a", " an", "-", ":", ","]
RETRY_ERRORS = ["timeout", "provider_error", "unexpected_error"]

# ---- response post-processing ----
WRAPPERS = [
    r"\A\s*Sure[,!.\s]*", r"\A\s*Here is .*?:\s*", r"\A\s*Here are .*?:\s*", r"\A\s*Below is .*?:\s*", r"\A\s*Of course[,!.\s]*", r"\A\s*Certainly[,!.\s]*",
]
#: With the assistant's own name in place of NAME.
NAMED_WRAPPERS = [r"\A\s*Hello!?[\s\S]{0,120}?NAME[\s\S]{0,120}?\n+", r"\A\s*I am NAME[\s\S]{0,120}?\n+", r"\A\s*As NAME[\s\S]{0,120}?\n+"]
LATE_WRAPPERS = [r"\A\s*Here'?s a structured summary[\s\S]{0,80}?\n+", r"\A\s*Here'?s a concise summary[\s\S]{0,80}?\n+", r"\A\s*The following notes[\s\S]{0,80}?\n+"]
RESOURCE_HEADS = ["Additional Resources", "Further Reading", "Recommended Resources", "External Resources"]
RESOURCE_WORDS = ["Online Courses", "Textbooks", "Journals", "Websites"]
CLOSINGS = [r"^by following these .*", r"^in conclusion[, ].*", r"^overall[, ].*", r"^this summary .*", r"^these notes .*", r"^hope this helps.*", r"^let me know .*"]
BROKEN_BULLETS = ["-", "--", "---", "- -", "- --", "- ---", "- .", "- ,", "- ;", "- :"]

# ---- output formatting ----
NAMED_SECTIONS = {
    "meeting_minutes": ["Agenda", "Discussion", "Decisions", "Action Items"],
    "structured_report": ["Overview", "Findings", "Details", "Risks or Gaps", "Conclusion"],
    "executive_summary": ["Context", "Key Points", "Implications", "Next Steps"],
    "beginner_explanation": ["Big Idea", "Simple Explanation", "Key Terms", "Quick Recap"],
    "revision_sheet": ["Must Know", "Definitions", "Quick Facts", "Final Review"],
}
NOT_AVAILABLE = "Not clearly available in the provided content."
UNSPECIFIED = "Not specified"
EMAIL_SHELL = ["subject:", "subject: not specified", "dear recipient,", "dear recipient", "hello,", "hi,", "body", "email body", "regards,", "sincerely,", "best regards,", "your name", "sender name"]
NO_EMAIL_SOURCE = "The required email details are not clearly available in the provided content."
NO_TEXT = "Generation unavailable\nThe document text could not be extracted clearly enough to generate this output."
LIMITED = {"student": "Study Output Temporarily Limited", "professional": "Professional Output Temporarily Limited", "general": "Generation temporarily unavailable"}
#: With the assistant's own name in place of NAME.
FALLBACK_NOTICE = "The AI provider did not return a complete response, so NAME preserved the most relevant extracted text instead of returning an empty document."
LIMIT_MESSAGE = "This output is based on the processed portion of the document because the current free-tier chunk limit was reached."
OMITTED = "Full content omitted to reduce token usage. Use only the semantic chunks and structure summary above."
