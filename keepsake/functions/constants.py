"""Fixed values that must equal the behaviour being reproduced.

FIXED VALUES — kept verbatim, in natural order, in one place.
"""

# --- extension classes used by deduplication and similarity search ---
DEDUP_IMAGE_EXTS = [".jpg", ".jpeg", ".png", ".heic"]
DEDUP_VIDEO_EXTS = [".mp4", ".mov", ".avi", ".mkv"]

# --- extension classes of the file-type report ---
REPORT_PHOTO_EXTS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif",
                     ".webp", ".raw", ".heic", ".heif", ".jfif"]
REPORT_VIDEO_EXTS = [".mp4", ".avi", ".mov", ".wmv", ".flv", ".mkv", ".webm",
                     ".m4v", ".3gp", ".mpg", ".mpeg", ".mts"]

# --- one-sample-per-extension test mode (conversion stage) ---
SAMPLE_EXTS = [".jpg", ".gif", ".png", ".heic", ".jpeg", ".tif", ".webp",
               ".jfif", ".tiff", ".3gp", ".avi", ".mpg", ".mov", ".mp4",
               ".mts", ".thm", ".dng", ".nef"]

# --- conversion targets ---
IMAGE_TO_JPG_EXTS = [".png", ".heic", ".dng", ".tif", ".tiff", ".gif"]
VIDEO_TO_MP4_EXTS = [".avi", ".mpg", ".mpeg", ".mts", ".3gp"]

# --- keeper scoring: a name containing any of these is "not clean" ---
UNCLEAN_NAME_MARKS = ["(1)", "_1", "copy", "edited"]

# --- quarantine / work folders under the processing root ---
UNMATCHED_JSON_DIR = "__UNMATCHED_JSON__"
UNMATCHED_MEDIA_DIR = "__UNMATCHED_MEDIA__"
FAILED_DIR = "__FAILED_FILES__"
SIM_DIR = "__SIM__"
DUPLICATE_GROUPS_DIR = "__DUPLICATE_GROUPS__"
# parts dropped when a path is moved to quarantine
QUARANTINE_DROP_PARTS = ["takeout", "google photos"]
# inserted after the archive part when a file is restored
RESTORE_INSERT_PARTS = ["Takeout", "Google Photos"]

# --- patterns ---
# year folder: a path part starting with this (prefix match) ...
YEAR_FOLDER_PREFIX_RE = r"Photos from [0-9]{4}"
# sidecar name -> (base, ext, dup): base.ext.<anything>(dup).json
SIDECAR_NAME_RE = r"(?i)^(.+)\.([^.]+)\.[^.]*?(?:\((\d+)\))?\.json$"
# sidecar rename after media rename: (media part)(sidecar suffix)
SIDECAR_SUFFIX_RE = r"^(.+?\.[^.]+)(\..+?\.json)$"
# archive number in a downloaded zip name
ARCHIVE_NUMBER_RE = r"-(\d{3})\.zip$"
# conversion marker searched in every cell
CONVERSION_MARKER_RE = r"(?i)_conv.\b"
# tool-log progress and summary words
TOOL_PROGRESS_RE = r"\[(\d+)/(\d+)\]$"
TOOL_SUMMARY_WORDS = ["directories", "files updated", "skipped", "error", "warning"]
# tags kept from a tag dump
TAG_DUMP_KEYS = ["Track Create Date", "Media Create Date", "Date/Time Original"]
# magic bytes
JPEG_MAGIC_HEX = "FFD8FF"
FTYP_HEX = "66747970"   # b"ftyp" at offset 4
QT_HEX = "7174"         # b"qt" anywhere in the first 12 bytes

# --- thresholds ---
HAMMING_THRESHOLD = 10          # near-match distance for reconciliation
PIXEL_DIFF_FIRST_PASS = 3.0     # pixel mean-abs-diff guard inside dedup
PIXEL_DIFF_SECOND_PASS = 10.0   # second-look guard
PHASH_DIST_SECOND_PASS = 4      # second-look perceptual-hash distance

# --- time format of formatted capture times (UTC) ---
TIME_FORMAT = "yyyy:MM:dd HH:mm:ss"

# --- where the capture time sits in a sidecar JSON document ---
SIDECAR_TIME_JSON_PATH = "$.photoTakenTime.timestamp"

# --- texts written into the manifest ---
NOTE_NO_MEDIA = "No media match found in "        # + year folder
NOTE_NO_JSON = "No JSON match found in "          # + year folder
NOTE_RECOVERED = "Recovered match"
NOTE_PATH_UPDATED = " updated to "                # <column> updated to <path>
REASON_KEEPER = "best_candidate"
REASON_DUPLICATE = "phash"
REASON_UNCERTAIN = "guardrail_uncertain"
GROUP_ID_FORMAT = "group_%04d"
STATUS_DELETED = "deleted"
STATUS_NOT_DELETED = "not_deleted"
ACTION_RENAMED = "Renamed "                       # Renamed <old> → <new>
ACTION_ARROW = " → "
ACTION_CONVERTED = "Converted → "                 # + new name
ACTION_CONVERTED_VIDEO = "Converted ."            # Converted .<ext> → .mp4
ACTION_TO_MP4 = " → .mp4"

# --- name parts of derived files ---
CONV_MARK = "_conv"          # <stem>_<tag>_conv<suffix>
SIM_MARK = "_sim"            # <stem>_sim<suffix>
RESTORED_MARK = "_restored"  # <stem>_restored<suffix>, then _restored_1 ...

# --- fuzzy keys: trailing ".json" (with any dots before it), kept characters ---
FUZZY_JSON_SUFFIX_RE = r"\.+json$"
FUZZY_DROP_RE = "[^a-zA-Z0-9]"
