"""Label sets, thresholds tables and text patterns.

Results depend on these exact values.  They are data, not logic.
"""

# Audio-event labels grouped by what they are evidence for.
SPEECH = (
    "Speech", "Male speech, man speaking", "Female speech, woman speaking", "Child speech, kid speaking",
    "Conversation", "Narration, monologue", "Babbling", "Whispering",
)
EXPRESSIVE = (
    "Shout", "Bellow", "Whoop", "Yell", "Battle cry", "Children shouting", "Screaming", "Crying, sobbing",
    "Whimper", "Wail, moan", "Groan", "Grunt",
)
SOFT_LAUGH = ("Giggle", "Snicker", "Chuckle, chortle")
LOUD_LAUGH = ("Belly laugh",)
IMPACT = ("Slam", "Coin (dropping)", "Thump, thud", "Bang", "Smash, crash", "Breaking", "Clatter")
RESPIRATORY = ("Breathing", "Gasp", "Sigh", "Pant", "Snort", "Wheeze", "Sneeze", "Cough", "Throat clearing")
AIRFLOW = ("Spray", "Steam", "Hiss", "Sizzle")
MOUTH = ("Chewing, mastication", "Biting", "Crunch", "Squish", "Squelch")
HEARTBEAT = ("Heart sounds, heartbeat",)
TAPPING = ("Tap", "Knock")
SURFACE = (
    "Crackle", "Crushing", "Stir", "Rub", "Scratch", "Scrape", "Rustle", "Crumpling, crinkling",
    "Whoosh, swoosh, swish", "Water", "Liquid", "Stirring",
)

# Output column -> labels; the column is the largest of their scores.
SCORE_COLUMNS = {
    "speech": SPEECH,
    "speech_base": ("Speech",),
    "expressive": EXPRESSIVE,
    "whisper": ("Whispering",),
    "voiced": tuple(x for x in SPEECH if x not in ("Speech", "Babbling", "Whispering")),
    "lexical": tuple(x for x in SPEECH if x not in ("Speech", "Babbling")),
    "soft_laugh": SOFT_LAUGH,
    "loud_laugh": LOUD_LAUGH,
    "laughter": ("Laughter",),
    "impact": IMPACT,
    "heartbeat": HEARTBEAT,
    "tapping": TAPPING,
    "breath": RESPIRATORY,
    "airflow": AIRFLOW,
    "mouth": MOUTH,
    "texture": MOUTH + HEARTBEAT + TAPPING + SURFACE,
    "music": ("Music",),
    "spray": ("Spray",),
    "hiss": ("Hiss",),
    "steam": ("Steam",),
    "sizzle": ("Sizzle",),
    "liquid": ("Water", "Liquid", "Pour", "Fill (with liquid)", "Gurgling"),
    "container": ("Glass", "Chink, clink"),
    "gargle": ("Gargling",),
}

# Order and number of text prompts per semantic group.
SEMANTIC_PROMPTS = (
    ("mouth", 3), ("surface", 2), ("tapping", 2), ("heartbeat", 2), ("speech", 3), ("whisper_asmr", 3),
    ("normal_speech", 3), ("break", 4), ("other", 4), ("bottle_cap", 3), ("drinking", 3), ("swallow", 2),
    ("handling", 2), ("water", 2),
)
MENU_PROMPTS = (
    ("wet_mouth", 2), ("mouth_clicks", 2), ("brushing", 2), ("rubbing", 2), ("tapping", 2), ("crinkling", 2),
    ("heartbeat", 2), ("airflow", 2), ("water", 2), ("laughter", 1), ("whisper", 2), ("speech", 2), ("music", 1),
    ("background", 2),
)

# Chapter categories that may share one "mixed" chapter, and chapter titles.
MIXABLE = ("wet_mouth", "mouth_clicks", "brushing", "rubbing", "tapping", "crinkling", "heartbeat", "whisper")
TITLES = {
    "wet_mouth": "舔耳 / 湿润口腔音",
    "mouth_clicks": "唇音 / 口腔轻响",
    "brushing": "刷麦 / 轻刷",
    "rubbing": "摩擦 / 抓挠",
    "tapping": "道具敲击",
    "crinkling": "揉纸 / 细碎沙沙声",
    "heartbeat": "心跳",
    "airflow": "呼气 / 气流",
    "water": "水声 / 饮水",
    "laughter": "笑声",
    "whisper": "轻语 / 耳语",
    "speech": "疑似说话",
    "music": "背景音乐",
    "background": "安静 / 背景声",
    "unknown": "待确认",
    "mixed": "混合 ASMR",
}

# Excluded category -> (setting that keeps it, default of the setting).
RETENTION = {
    "soft_laugh": ("keep_soft_laugh", True),
    "loud_laugh": ("keep_loud_laugh", False),
    "airflow": ("keep_vaping", False),
    "drinking": ("keep_drinking", False),
    "impacts": ("keep_impacts", False),
    "heartbeat": ("keep_heartbeat", True),
    "tapping": ("keep_tapping", True),
}
KEEP_DEFAULTS = {"keep_whisper": True, **{setting: default for setting, default in RETENTION.values()}}

# Settings with their defaults and ranges.
SETTING_DEFAULTS = {
    "mode": "relaxed",
    "language": "auto",
    "device": "auto",
    "output_kind": "auto",
    "video_cut_mode": "copy",
    "audio_output_codec": "source",
    "strict_pre": 5.0,
    "strict_post": 7.0,
    "strict_min_section": 40.0,
    "strict_dense_gap": 20.0,
    "silence_db": -58.0,
    "max_pause_seconds": 1.5,
    "join_fade_enabled": False,
    "join_fade_seconds": 0.3,
    "edge_fade_enabled": True,
    "edge_fade_seconds": 0.5,
    "review_enabled": True,
    "generate_program_menu": True,
    "review_max_passes": 3,
    **KEEP_DEFAULTS,
}
SETTING_CHOICES = {
    "mode": ("strict", "relaxed", "extract"),
    "language": ("auto", "ko", "ja", "zh", "en"),
    "device": ("auto", "cpu", "cuda"),
    "output_kind": ("auto", "audio", "video"),
    "video_cut_mode": ("copy", "precise"),
    "audio_output_codec": ("source", "flac", "pcm", "aac"),
}
SETTING_RANGES = {
    "strict_pre": (0, 60),
    "strict_post": (0, 60),
    "strict_min_section": (1, 600),
    "strict_dense_gap": (0, 120),
    "silence_db": (-90, -20),
    "max_pause_seconds": (0.3, 10),
    "join_fade_seconds": (0.05, 2),
    "edge_fade_seconds": (0.05, 3),
    "review_max_passes": (1, 5),
}

# Text patterns.  Closing phrases of videos (searched anywhere in a text).
OUTRO_PATTERN = (
    r"다음\s*영상|시청.*감사|영상.{0,25}감사|봐주.{0,15}감사|구독|자막|영상.*만나요|thanks?\s+for\s+watching|subscribe"
    r"|ご視聴|字幕|感谢观看|謝謝觀看"
)
# Syllables without words (the whole cleaned text).
SYLLABLE_PATTERN = (
    r"[으음어아오우흐흠하헤히헉휴후응웅잉에엥크킁흫와예악윽앗헐야ㅎㅋ]+|(?:[aumoh]+|ah|uh|hmm|ha)+|(?:he|hi|ho){2,}"
    r"|[啊嗯哦呃唔哈呵嘻嘿はあうんえお]+"
)
# Laughter written out (the whole cleaned text).
LAUGH_PATTERN = r"(?:ha|he|hi|ho|ah|哈|呵|嘻|嘿|하|허|히|호|흐|ㅎ|ㅋ)+"
# Somebody says they are about to drink.
DRINK_PATTERN = (
    r"(?:喝|喝点|喝口|喝一口|喝点儿)\s*水|(?:饮水|喝茶)"
    r"|(?:물|차)(?:을|를)?\s*(?:좀\s*|한\s*(?:모금|잔)\s*)?(?:마시|마실|마셔)"
    r"|(?:水|お茶)(?:を)?(?:ちょっと|少し|一口|\s)*飲(?:み|む|も|ん)|(?:drink|sip)(?:ing)?\s+(?:some\s+|a\s+little\s+)?water"
)
# Language names reported by one transcriber -> codes.
LANGUAGE_CODES = {"Korean": "ko", "Japanese": "ja", "Chinese": "zh", "English": "en"}
ALIGNED_BACKEND = "qwen3-asr"
