"""Schemas and fixed values of the document index."""

from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("folder_path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("last_modified_ticks", T.LongType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
    ]
)

# Labels of file types by extension; any other extension is OTHER_TYPE.
FILE_TYPES = {
    ".docx": "Word文書",
    ".xlsx": "Excelブック",
    ".pptx": "PowerPointプレゼンテーション",
    ".pdf": "PDFファイル",
    ".txt": "テキストファイル",
    ".csv": "CSVファイル",
    ".log": "ログファイル",
    ".md": "Markdownファイル",
    ".cs": "C#ソースコード",
    ".js": "JavaScriptファイル",
    ".ts": "TypeScriptファイル",
    ".py": "Pythonファイル",
    ".java": "Javaファイル",
    ".html": "HTMLファイル",
    ".css": "CSSファイル",
    ".xml": "XMLファイル",
    ".json": "JSONファイル",
    ".yaml": "YAMLファイル",
    ".yml": "YAMLファイル",
    ".pas": "Pascal/Delphi",
    ".dpr": "Pascal/Delphi",
    ".dpk": "Pascal/Delphi",
}
OTHER_TYPE = "ファイル"

# Extensions that each extractor reads.
OFFICE_EXTENSIONS = (".docx", ".xlsx", ".pptx")
PDF_EXTENSIONS = (".pdf",)
TEXT_EXTENSIONS = (
    ".txt .csv .log .md .cs .js .ts .jsx .tsx .py .java .cpp .c .h .hpp .pas .dpr .dpk .html .htm .css .scss .sass .less "
    ".xml .json .yaml .yml .sql .sh .bat .ps1 .ini .cfg .conf .config .gitignore .env"
).split()

# Icon classes by extension; any other extension is "text".
ICONS = {
    "word": ".doc .docx".split(),
    "excel": ".xls .xlsx".split(),
    "ppt": ".ppt .pptx".split(),
    "pdf": [".pdf"],
    "code": ".cs .js .ts .py .java .cpp .c .h .go .rs .rb .php .swift .kt .scala .vb .fs".split(),
}

# Folders that a scan leaves out, besides those whose name starts with "$".
SYSTEM_FOLDERS = ("System Volume Information", "Windows", "Program Files", "Program Files (x86)", "ProgramData")

# Limits.
MAX_TEXT_FILE_BYTES = 10 * 1024 * 1024
MAX_ANALYSED_CHARS = 500_000
MAX_TERM_BYTES = 32_765
PREVIEW_CHARS = 50_000
MAX_QUERY_WORDS = 64
MAX_FRAGMENTS, FRAGMENT_CHARS = 5, 100
DEFAULT_RESULTS = 1_000
FILE_NAME_BOOST = 2.5

# Messages.
PREVIEW_CUT = "\n... (省略)"
NO_PREVIEW, PREVIEW_ERROR, NO_PATH, CANCELLED = "[プレビュー不可]", "[エラー] ", "ファイルパスが指定されていません", "[キャンセル]"
NEVER, JUST_NOW, MINUTES_AGO, HOURS_AGO, DAYS_AGO = "未実行", "たった今", "分前", "時間前", "日前"
SKIPPED = "（スキップ {} 件）"
AUTO_REBUILD_MINUTES = (0, 30, 60, 120, 360, 720, 1440, 10080)

#: Microseconds between 0001-01-01 and 1970-01-01; a tick is 100 ns.
TICKS_EPOCH_MICROS = 62_135_596_800_000_000
