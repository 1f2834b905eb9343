"""Word lists that results depend on, in their original order."""

# Legal terms that keywords are taken from.
LEGAL_TERMS = (
    "quyền dân sự", "cá nhân", "pháp nhân", "hợp đồng", "tài sản", "sở hữu", "thừa kế", "người chưa thành niên",
    "người có khó khăn trong nhận thức", "giám hộ", "bồi thường", "thiệt hại", "nghĩa vụ", "giao dịch", "đại diện",
    "chứng cứ", "hết thời hiệu", "khoản", "điểm", "điều",
)

# Categories of concepts, the first whose word is contained.
CONCEPT_CATEGORIES = (
    ("person", ("người", "cá nhân")),
    ("property", ("tài sản", "sở hữu")),
    ("contract", ("hợp đồng", "thỏa thuận")),
    ("inheritance", ("thừa kế", "di chúc")),
    ("family", ("gia đình", "kết hôn", "ly hôn")),
    ("tort", ("bồi thường", "thiệt hại")),
)

# Words that route a query.
SHARED_TERMS = ("sở hữu chung", "tài sản chung", "vốn chung", "nợ chung", "nghĩa vụ chung", "sống chung", "con chung", "sử dụng chung")
SUMMARY_TERMS = ("tóm tắt", "tổng quan", "khái quát")
GLOBAL_TERMS = ("tóm tắt", "tổng quan", "khái quát", "chung", "phần", "chương", "mục", "toàn bộ", "tất cả", "quy định về", "nguyên tắc")
LOCAL_TERMS = ("điều", "khoản", "điểm", "chi tiết", "cụ thể", "thủ tục", "bao nhiêu", "là gì", "thế nào")

# Entity type, confidence, keywords.
ENTITY_KEYWORDS = (
    ("person", 0.8, ("người", "cá nhân", "chồng", "vợ", "con", "cha", "mẹ")),
    ("organization", 0.7, ("công ty", "doanh nghiệp", "tổ chức", "cơ quan")),
    ("property", 0.6, ("nhà", "đất", "xe", "tài sản")),
    ("contract", 0.9, ("hợp đồng", "thỏa thuận", "cam kết")),
)

# Words that are no key terms.
KEY_TERM_STOPS = (
    "và", "của", "là", "có", "các", "những", "không", "được", "cho", "này", "đó", "về", "gì", "nào", "một", "với", "khi", "thì", "ở", "để", "bị",
    "the", "a", "an", "of", "to", "in", "is", "are", "was", "what", "did", "do", "i", "you", "we", "my", "me", "it", "on", "at", "for", "and", "or",
)

# Folded words that BM25 leaves out.
FOLDED_STOPS = (
    "la", "cua", "va", "co", "cac", "duoc", "do", "theo", "cho", "trong", "mot", "nhung", "gi", "thi", "ve", "voi", "khi", "nao", "bao", "nhieu",
    "khong", "the", "nay", "tai", "tu", "den", "se", "bi", "hay", "hoac",
)

# Suggested queries.
SUGGESTIONS = (
    "Quyền của người chưa thành niên", "Điều kiện kết hợp đồng", "Sở hữu tài sản chung", "Thừa kế theo pháp luật",
    "Bồi thường thiệt hại", "Hủy giao dịch dân sự", "Giám hộ cho người có khó khăn", "Thời hiệu khởi kiện",
)

# Ordinals of parts, by number.
PART_ORDINALS = (("thứ nhất", 1), ("thứ hai", 2), ("thứ ba", 3), ("thứ tư", 4), ("thứ năm", 5), ("thứ sáu", 6), ("thứ bảy", 7))

# Phrases that refer to the conversation or name a question of it,
# with whether a space in them stands for any white space.
RECALL_PHRASES = {
    "me": (True, ("tôi", "mình", "em", "chúng tôi", "chúng mình")),
    "spoke": (True, ("hỏi", "nói", "nhắc", "đề cập")),
    "conversation_vi": (True, ("{me} (?:đã|vừa) (?:{spoke})", "lúc nãy", "vừa rồi", "lần trước", "nhắc lại", "vừa hỏi")),
    "conversation_en": (False, (
        "do you (?:still )?(?:remember|recall)", "(?:remember|recall) (?:what|when|who|that|my|our|me)", "last time", "did i (?:ask|say|mention|tell)",
        "(?:did|have) (?:i|we) (?:ask|say|mention|tell you|talk about|discuss)", "(?:i|we) (?:asked|said|mentioned|told you|talked about|discussed)", "you (?:said|told me|mentioned)",
    )),
    "first_marked": (True, ("câu (?:hỏi )?đầu(?: tiên)? (?:của )?{me}", "{me} (?:đã |vừa )?hỏi câu (?:hỏi )?đầu tiên", "câu (?:hỏi )?đầu tiên {me} (?:đã |vừa )?hỏi")),
    "first_en": (True, ("first question",)),
    "first_thing": (True, ("first thing",)),
    "first_key": (True, ("câu hỏi đầu tiên", "câu (?:hỏi )?đầu(?: tiên)? (?:của )?{me}", "{me} (?:đã |vừa )?hỏi câu (?:hỏi )?đầu tiên")),
    "first_bare": (True, ("câu đầu tiên", "câu hỏi đầu")),
    "context": (True, ("bạn", "{spoke}")),
    "recent_vi": (True, ("(?:đã|vừa) (?:{spoke})", "lúc nãy", "vừa rồi", "lần trước", "nhắc lại", "vừa hỏi")),
    "before": (True, ("trước đó",)),
    "earlier": (True, ("earlier",)),
}

# Letters that name points, Latin ones and those of Vietnamese.
POINT_LETTERS = "a-zàáảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"


def roman_numerals(most: int = 40) -> dict[str, int]:
    """Roman numerals from 1, by the usual rule."""
    steps = ((40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
    out = {}
    for n in range(1, most + 1):
        rest, text = n, ""
        for value, sign in steps:
            text += sign * (rest // value)
            rest %= value
        out[text] = n
    return out

# Types of evaluation cases.
CASE_TYPES = (
    "seed", "multi_hop", "explicit_article", "global", "small_talk", "recall_basic", "recall_fresh", "recall_far", "followup_window",
    "isolation", "false_trigger",
)
# What a recall finds in a new session, and phrases that claim an earlier question.
FRESH_SESSION = "chưa có nội dung nào trước đó"
PRIOR_QUESTIONS = (
    "bạn đã hỏi", "bạn vừa hỏi", "bạn hỏi trước đó", "câu hỏi trước của bạn", "câu hỏi trước đó của bạn", "you asked", "you previously asked",
    "your previous question", "your earlier question",
)
# Tools, and the arguments of which they need one.
TOOL_ARGUMENTS = (
    ("search_legal_articles", ("query",)), ("traverse_references", ("article_id", "query")), ("get_community_context", ("query",)),
    ("get_article", ("article_number",)), ("recall_session", ("key",)),
)
