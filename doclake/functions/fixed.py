"""Constants that results depend on, stated once and as plain text."""

# --- fixed values: file extensions per category -------------------------------
FILE_CATEGORIES = {
    "text": [".txt", ".rtf"],
    "documents": [".pdf", ".doc", ".docx"],
    "spreadsheets": [".xlsx", ".xls", ".csv"],
    "presentations": [".ppt", ".pptx"],
    "images": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff"],
    "audio": [".mp3", ".wav", ".wma", ".m4a"],
    "video": [".mp4", ".mov", ".wmv", ".flv", ".avi"],
    "archives": [".zip", ".rar", ".7z"],
    "executables": [".exe", ".dll", ".bat", ".sys"],
}

# --- fixed values: characters that file names may not have, and that they do not end in
FORBIDDEN_IN_NAMES = r'[<>:"/\\|?*]'
TRIMMED_FROM_NAMES = "_. "

# --- fixed values: link targets that are files, not pages ---------------------
FILE_LINK_EXTENSIONS = [".pdf", ".doc", ".docx", ".jpg", ".png", ".gif", ".zip"]

# --- fixed values: word lists of the document sentiment score -----------------
POSITIVE_WORDS = ["good", "great", "excellent", "amazing", "wonderful"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "horrible", "poor"]

# --- fixed values: word lists of the rule based sentiment ---------------------
RULE_POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic",
    "outstanding", "superb", "brilliant", "awesome", "perfect",
]
RULE_NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "horrible", "poor", "disappointing",
    "unacceptable", "inadequate", "subpar", "mediocre",
]

# --- fixed values: substrings counted as invalid by the validity check --------
INVALID_MARKERS = ["\ufffd", "NULL", "undefined"]

# --- fixed values: placeholder texts for media without a transcript -----------
AUDIO_TEXT = "Audio content - transcription would require additional processing"
VIDEO_TEXT = "Video content - analysis would require additional processing"

# --- fixed values: patterns and units -----------------------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]

# --- fixed values: Unicode classes, written as Java regex class bodies --------
# White space as str.split() and str.strip() see it. The characters above Latin-1 stand
# behind a range test, so most characters are decided by two look-ups.
WHITESPACE = (
    r" \t\n\x0B\f\r\x1c\x1d\x1e\x1f\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
WHITESPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line boundaries as str.splitlines() sees them.
LINE_BREAKS = r"\n\r\x0B\f\x1c\x1d\x1e\x85\u2028\u2029"
# Digits as str.isdigit() sees them: decimal digits plus the digit forms below.
DIGITS = (
    r"0-9[\x{80}-\x{10ffff}&&[\p{Nd}\xb2\xb3\xb9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089"
    r"\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea"
    r"\u24f5-\u24fd\u24ff\u2776-\u277e\u2780-\u2788\u278a-\u2792"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]]"
)
