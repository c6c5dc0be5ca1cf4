"""Word lists, phrases, labels and book names that results depend on."""

from __future__ import annotations

#: Books in canonical order with their number of chapters.
BOOKS = {
    "Genesis": 50, "Exodus": 40, "Leviticus": 27, "Numbers": 36, "Deuteronomy": 34, "Joshua": 24, "Judges": 21, "Ruth": 4,
    "1 Samuel": 31, "2 Samuel": 24, "1 Kings": 22, "2 Kings": 25, "1 Chronicles": 29, "2 Chronicles": 36, "Ezra": 10,
    "Nehemiah": 13, "Esther": 10, "Job": 42, "Psalm": 150, "Proverbs": 31, "Ecclesiastes": 12, "Song of Solomon": 8,
    "Isaiah": 66, "Jeremiah": 52, "Lamentations": 5, "Ezekiel": 48, "Daniel": 12, "Hosea": 14, "Joel": 3, "Amos": 9,
    "Obadiah": 1, "Jonah": 4, "Micah": 7, "Nahum": 3, "Habakkuk": 3, "Zephaniah": 3, "Haggai": 2, "Zechariah": 14, "Malachi": 4,
    "Matthew": 28, "Mark": 16, "Luke": 24, "John": 21, "Acts": 28, "Romans": 16, "1 Corinthians": 16, "2 Corinthians": 13,
    "Galatians": 6, "Ephesians": 6, "Philippians": 4, "Colossians": 4, "1 Thessalonians": 5, "2 Thessalonians": 3,
    "1 Timothy": 6, "2 Timothy": 4, "Titus": 3, "Philemon": 1, "Hebrews": 13, "James": 5, "1 Peter": 5, "2 Peter": 3,
    "1 John": 5, "2 John": 1, "3 John": 1, "Jude": 1, "Revelation": 22,
}
#: Verses of the books of one chapter.
ONE_CHAPTER_VERSES = {"Obadiah": 21, "Philemon": 25, "2 John": 13, "3 John": 15, "Jude": 25}
#: Other names of books.
BOOK_ALIASES = {
    "Genesis": ["Gen"], "Exodus": ["Exod", "Ex"], "Leviticus": ["Lev"], "Numbers": ["Num"], "Deuteronomy": ["Deut"], "Joshua": ["Josh"], "Judges": ["Judg"],
    "1 Samuel": ["1 Sam", "First Samuel"], "2 Samuel": ["2 Sam", "Second Samuel"], "1 Kings": ["First Kings"], "2 Kings": ["Second Kings"],
    "1 Chronicles": ["1 Chron", "First Chronicles"], "2 Chronicles": ["2 Chron", "Second Chronicles"], "Nehemiah": ["Neh"], "Esther": ["Esth"],
    "Psalm": ["Psalms", "Ps", "Psa"], "Proverbs": ["Prov"], "Ecclesiastes": ["Eccl", "Eccles"], "Song of Solomon": ["Song", "Song of Songs"],
    "Isaiah": ["Isa"], "Jeremiah": ["Jer"], "Lamentations": ["Lam"], "Ezekiel": ["Ezek"], "Daniel": ["Dan"], "Hosea": ["Hos"], "Obadiah": ["Obad"],
    "Micah": ["Mic"], "Nahum": ["Nah"], "Habakkuk": ["Hab"], "Zephaniah": ["Zeph"], "Haggai": ["Hag"], "Zechariah": ["Zech"], "Malachi": ["Mal"],
    "Matthew": ["Matt", "Mt"], "Mark": ["Mk"], "Luke": ["Lk"], "John": ["Jn"], "Romans": ["Rom"],
    "1 Corinthians": ["1 Cor", "First Corinthians"], "2 Corinthians": ["2 Cor", "Second Corinthians"], "Galatians": ["Gal"], "Ephesians": ["Eph"],
    "Philippians": ["Phil"], "Colossians": ["Col"], "1 Thessalonians": ["1 Thess", "First Thessalonians"], "2 Thessalonians": ["2 Thess", "Second Thessalonians"],
    "1 Timothy": ["1 Tim", "First Timothy"], "2 Timothy": ["2 Tim", "Second Timothy"], "Philemon": ["Philem"], "Hebrews": ["Heb"], "James": ["Jas"],
    "1 Peter": ["1 Pet", "First Peter"], "2 Peter": ["2 Pet", "Second Peter"], "1 John": ["First John"], "2 John": ["Second John"], "3 John": ["Third John"],
    "Revelation": ["Rev"],
}
#: Number words.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
#: Words that announce a chapter or a verse, and words around a book's name that say it is a book.
CHAPTER_CUES, VERSE_CUES = ("chapter", "chapters", "ch"), ("verse", "verses")
BOOK_NOUNS = ["book", "letter", "gospel", "prophecy", "prophet", "story", "series", "week", "preaching", "sign"]
OPENING_VERBS = ["turn", "turning", "open", "open up", "open your bible", "open up your bible", "flip", "flipping", "go", "going", "walk", "walking", "study", "studying", "preach", "preaching", "preached"]
OPENING_PREPOSITIONS = ["to", "through", "from", "on", "in"]
PLACE_PREPOSITIONS = ["in", "from", "through", "throughout", "inside"]
BEHIND_BOOK = ("chapter", "chapters", "verse", "verses", "series", "sermon", "week", "part")
#: Phrases that open the text of the day, and phrases that announce another.
OPENING_WORDS = ["turn", "turning", "open", "flip", "flipping", "our text", "our passage"]
OPENING_SUBJECTS, OPENING_DAYS, OPENING_DAY_VERBS = ["we're", "we are"], ["today", "this morning"], ["in", "looking at"]
LATER_PHRASES = ["next week", "next month", "later", "eventually", "in a few weeks"]
#: Words without weight.
STOPWORDS = """about after again against also because been before being between church could does doing down each even every from
    going good have here into just know like look make many more most much need only other over people really right said same
    sermon should some than that their them then there these they thing things this those through time want were what when where
    which while will with would your""".split()
#: Phrases that keep a sentence out of a summary, and those that favour it.
SKIP_PHRASES = ["all right", "before i read", "grab a bible", "heavenly father", "if you have a bible", "if you will grab", "i'm going to pray", "last week", "let me just recap", "my name is", "open up your bibles", "turn to", "we are back", "we're going to be", "we're going to look", "we're going to read", "we've labeled it", "welcome", "you should be excited"]
SIGNAL_PHRASES = ["the point", "main point", "what we see", "what's wonderful", "the picture", "that means", "there is a day coming", "the sermon calls", "the passage shows", "we should", "we need", "my hope", "hope is", "restoration", "eternity", "gospel", "kingdom", "peace", "glory"]
#: Labels with the keywords that count for them.
THEMES = {
    "Gospel": ["gospel", "cross", "resurrection", "atonement", "good news"],
    "Grace": ["grace", "mercy", "forgive", "forgiveness"],
    "Discipleship": ["disciple", "follow jesus", "obedience", "formation"],
    "Mission": ["mission", "evangel", "nations", "sent", "witness"],
    "Prayer": ["pray", "prays", "praying", "prayer", "intercede", "lament"],
    "Scripture": ["scripture", "bible", "word of god"],
    "Church": ["church membership", "body of christ", "members", "elders", "deacons"],
    "Worship": ["worship", "praise", "glory", "sing"],
    "Wisdom": ["wisdom", "wise", "fool", "proverbs"],
    "Suffering": ["suffer", "suffering", "pain", "grief", "trial"],
    "Holiness": ["holy", "holiness", "sanctification", "repent"],
    "Justice and Mercy": ["justice", "mercy", "poor", "oppressed", "neighbor"],
    "Marriage and Family": ["marriage", "husband", "wife", "parenting", "family"],
    "Generosity": ["generous", "generosity", "money", "giving", "steward", "treasure"],
    "Identity in Christ": ["identity", "in christ", "adoption", "beloved"],
    "Eschatology": ["second coming", "day of the lord", "kingdom of god", "kingdom of heaven", "revelation", "eternity"],
    "Holy Spirit": ["holy spirit", "spirit", "pentecost"],
}
TOPICS = {
    "Faith": ["faith", "believe", "trust"],
    "Hope": ["hope", "future", "promise"],
    "Love": ["love", "beloved", "neighbor"],
    "Repentance": ["repent", "repentance", "confess"],
    "Idolatry": ["idol", "idolatry", "false god"],
    "Anxiety and Fear": ["anxiety", "anxious", "fear", "afraid"],
    "Spiritual Warfare": ["warfare", "armor", "enemy", "satan"],
    "Leadership": ["leader", "elder", "shepherd", "pastor"],
    "Community": ["community", "one another", "small group"],
    "Work and Rest": ["workplace", "vocation", "labor", "sabbath", "rest"],
    "Hospitality": ["hospitality", "welcome", "stranger"],
    "Sexual Ethics": ["sex", "sexual", "desire", "purity"],
    "Money": ["money", "wealth", "rich", "treasure"],
    "Parenting": ["parenting", "parents", "our children", "your children", "kids"],
    "Forgiveness": ["forgive", "forgiveness", "reconcile"],
}
#: Least scores of labels that match easily; 4 for all others.
LABEL_MINIMUM = {"Marriage and Family": 12, "Parenting": 12, "Love": 8, "Money": 8}
#: Defaults and flags.
UNTITLED = "Untitled Sermon"
NO_SPEAKER, NO_SERIES = "Add or confirm speaker.", "Add or confirm series."
NO_TRANSCRIPT = "Transcript missing; page is metadata-only until a transcript is added."
INFERRED_CLAIM, INFERRED_FLAG = "Scripture reference was inferred from the title/transcript and should be reviewed.", "Review inferred scripture reference."
CONTENT_FLAG = "Generated content summary/themes were added locally; review before relying on them."
EXTERNAL_FLAG = "AI-generated summary/themes were added by external command; review before relying on them."
ORGANISATION_WORDS = ["church", "team", "staff", "ministry", "ministries"]
