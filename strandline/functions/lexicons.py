"""Rule parameters: defaults for Japanese; every operator takes its own lists."""

# Marks, word lists and thresholds that decide results.
TERMINAL_MARKS = ("。", "？", "！")
CLOSING_QUOTES = ("」", "』", "）", ")", "】", "］", "]", "〉", "》")
FINAL_PARTICLES = ("か", "ね", "よ", "な")
FINAL_SUFFIXES = ("ください", "下さい", "くださいね", "下さいね", "ます", "ました", "ません", "ませんか", "ましょう", "です", "でした", "でしょう", "だ", "だった")
CONTINUATION_PREFIXES = ("とき", "時", "場合", "ため", "ので", "のに", "なら", "けれど", "けど")
DISCOURSE_MARKERS = ("それでは", "ところで", "しかし", "では", "さて")
NON_DISCOURSE_PREFIXES = ("ではありません", "ではない", "ではなく", "ではなければ")
CONTENT_POS = ("名詞", "動詞", "形容詞", "副詞")
SKIPPED_SURFACES = ("する", "した", "して", "ある", "いる", "ます", "です")
COMMA, PERIOD = "、", "。"
AUDIO_FORMATS = {".aac": "aac", ".flac": "flac", ".m4a": "m4a", ".mp3": "mp3", ".ogg": "ogg", ".opus": "opus", ".wav": "wav", ".wave": "wav"}
STRONG_PAUSE, MIN_PAUSE, CONTINUATION_GAP = 1.5, 0.5, 0.2
MERGE_GAP, MERGE_CHARS = 0.35, 42
MAX_LENGTH_DELTA, MAX_CONTENT_CHANGE = 0.2, 0.2
TARGETS_PER_SENTENCE, MAX_LEXICAL, SCORE_MARGIN, MIN_CANDIDATE_SCORE, MIN_CHARS = 3, 64, 0.0, 0.001, 2
