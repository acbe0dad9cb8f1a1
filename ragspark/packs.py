"""Settings and language packs: what the operators take as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Defaults of ingest and retrieval."""

    parent_size: int = 900
    parent_overlap: int = 150
    child_size: int = 450
    child_overlap: int = 75
    top_k: int = 4
    vector_weight: float = 0.65
    rank_constant: int = 60
    fan_out: int = 4
    candidates: int = 3
    variants: int = 3
    min_vector: float = 0.30
    min_bm25: float = 2.0
    rerank_weights: tuple[float, float, float] = (0.45, 0.35, 0.20)
    history_messages: int = 6
    history_chars: int = 6000


# The Vietnamese word lists and patterns that results depend on.
DOMAIN_TERMS = (
    "học viện", "nhà trường", "sinh viên", "học tập", "khóa học", "học kỳ", "học phần", "môn học", "tín chỉ", "chương trình đào tạo", "chương trình",
    "đào tạo", "ngành học", "mã ngành", "ngành công nghệ", "ngành an toàn", "ngành marketing", "đăng ký môn", "đăng ký học", "học phí", "lệ phí",
    "học bổng", "tốt nghiệp", "cảnh báo học", "điểm trung bình", "điểm chữ", "thang điểm", "bảng điểm", "khiếu nại điểm", "cải thiện điểm", "học lại",
    "xếp loại", "gpa", "cpa", "thi cử", "kỳ thi", "thi hộ", "phúc khảo", "bảo lưu", "thôi học", "nghỉ học", "chuyển ngành", "chuyển trường", "rèn luyện",
    "kỷ luật", "khen thưởng", "thẻ sinh viên", "ký túc xá", "thư viện", "đoàn thanh niên", "công tác sinh viên", "thủ tục", "giấy xác nhận", "chứng chỉ",
    "chuẩn đầu ra", "giảng đường", "giảng viên", "giảng dạy", "lớp học", "vào lớp", "khảo thí", "thực tập", "cố vấn học tập", "thời khóa biểu", "lịch học",
    "lịch thi", "kế hoạch năm học", "nghỉ tết", "tết nguyên đán", "địa chỉ trường", "cơ sở đào tạo", "phòng đào tạo",
    "trưởng khoa", "phó trưởng khoa", "chủ nhiệm khoa", "chủ nhiệm bộ môn", "chủ nhiệm viện", "chủ nhiệm phòng", "chủ nhiệm trung tâm",
)
FOLLOW_UPS = (
    r"^(?:còn|thế còn|vậy|trường hợp này|trường hợp đó|quy định này|quy định đó|nó)\b",
    r"^(?:bao nhiêu|khi nào|ở đâu|tại sao|như thế nào|có được không|cần gì)\b",
)
RESOLVED = r"^(?:còn|thế còn|vậy|trường hợp (?:này|đó)|quy định (?:này|đó)|nó)\b"
BLOCKED = (
    ("code_generation", r"\b(?:viết|tạo|sinh|làm)\s+(?:cho\s+(?:tôi|mình|em)\s+)?(?:mã|code|script|chương trình)\b"),
    ("code_generation", r"\b(?:python|javascript|java|c\+\+|html|css|sql)\b.*\b(?:code|mã|script|lập trình)\b"),
    ("creative_request", r"\b(?:viết|sáng tác)\s+(?:một\s+)?(?:bài thơ|truyện|kịch bản|bài hát)\b"),
    ("general_task", r"\b(?:dịch|tóm tắt)\s+(?:đoạn|văn bản|bài viết)\s+(?:này|sau)\b"),
    ("general_task", r"\b(?:giải|làm)\s+(?:giúp\s+)?(?:bài toán|bài tập lập trình)\b"),
)
INJECTIONS = (
    r"\b(?:bỏ qua|quên đi|phớt lờ|ghi đè|vô hiệu hóa|không tuân theo)\b.{0,120}\b(?:hướng dẫn|chỉ dẫn|prompt|quy tắc|yêu cầu|nội dung phía trên|lệnh trước)\b",
    r"\b(?:ignore|forget|disregard|override|bypass|do not follow)\b.{0,120}\b(?:previous|prior|above|all|system|developer|instructions?|rules?|prompts?|messages?)\b",
    r"\b(?:hiển thị|tiết lộ|in ra|đọc lại|lặp lại|cho (?:tôi|mình) xem)\b.{0,100}\b(?:system prompt|developer message|chỉ dẫn hệ thống|prompt hệ thống|quy tắc nội bộ|hướng dẫn ẩn)\b",
    r"\b(?:show|reveal|print|repeat|recite|expose|output)\b.{0,100}\b(?:system prompt|developer message|hidden instructions?|internal rules?|initial prompt)\b",
    r"\b(?:what are|tell me|list)\b.{0,60}\b(?:your instructions|your system prompt|hidden rules)\b",
    r"\b(?:jailbreak|developer mode|dan mode|do anything now|unrestricted mode)\b",
    r"\b(?:đóng vai|giả vờ là|hãy là|act as|pretend to be|roleplay as)\b.{0,100}\b(?:system|developer|không giới hạn|unrestricted|dan|không có quy tắc)\b",
    r"(?:\[|<|#{1,6}\s*)(?:system|developer|assistant)(?:\]|>|\s*:)",
    r"\b(?:api key|openai_api_key|mật khẩu|password|secret key|biến môi trường|environment variables?)\b.{0,80}\b(?:hiển thị|tiết lộ|đọc|show|reveal|print|output)\b",
    r"\b(?:hiển thị|tiết lộ|đọc|show|reveal|print|output)\b.{0,80}\b(?:api key|openai_api_key|mật khẩu|password|secret key|biến môi trường|environment variables?)\b",
    r"\b(?:decode|giải mã)\b.{0,80}\bbase(?:64|6a)\b.{0,80}\b(?:follow|execute|thực hiện|làm theo)\b",
)
PREFIXES = (
    r"xin (?:cho )?hỏi",
    r"cho (?:mình|tôi|em) hỏi",
    r"(?:mình|tôi|em) (?:muốn|cần) hỏi",
    r"bạn có thể (?:cho (?:mình|tôi|em) )?biết",
    r"hãy cho (?:mình|tôi|em) biết",
)
ABBREVIATIONS = (
    ("đkhp", "đăng ký học phần"),
    ("ctsv", "công tác sinh viên"),
    ("bhyt", "bảo hiểm y tế"),
    ("gpa", "điểm trung bình gpa"),
    ("cpa", "điểm trung bình tích lũy cpa"),
    ("sv", "sinh viên"),
    ("gv", "giảng viên"),
)
DOUBLED = (("đăng ký đăng ký học phần", "đăng ký học phần"),)
TAILS = r"\s+(?:ạ|nhé|vậy|được không)[.!?\s]*$"
STOP_WORDS = (
    "ai", "bao", "biết", "có", "cho", "gì", "khi", "không", "là", "nào",
    "như", "ở", "sao", "thế", "thì", "tôi", "và", "về", "đâu", "được",
)
EXPANSIONS = (
    ("học phí", "học phí mức thu thời hạn đóng học phí"),
    ("cảnh báo học tập", "cảnh báo học tập cảnh báo học vụ điều kiện"),
    ("đăng ký học phần", "đăng ký học phần đăng ký môn học tín chỉ"),
    ("tốt nghiệp", "điều kiện xét công nhận tốt nghiệp"),
    ("học bổng", "điều kiện tiêu chuẩn xét học bổng"),
)


@dataclass(frozen=True)
class Pack:
    """The words and patterns of a language and a domain. Further domain terms, such as an institution's name, are added
    with dataclasses.replace(). Patterns are written for Unicode word boundaries."""

    domain_terms: tuple[str, ...] = DOMAIN_TERMS
    follow_ups: tuple[str, ...] = FOLLOW_UPS
    resolved: str = RESOLVED
    blocked: tuple[tuple[str, str], ...] = BLOCKED
    injections: tuple[str, ...] = INJECTIONS
    prefixes: tuple[str, ...] = PREFIXES
    abbreviations: tuple[tuple[str, str], ...] = ABBREVIATIONS
    doubled: tuple[tuple[str, str], ...] = DOUBLED
    tails: str = TAILS
    stop_words: tuple[str, ...] = STOP_WORDS
    expansions: tuple[tuple[str, str], ...] = EXPANSIONS
    article: str = "Điều"
    clause: str = "Khoản"
    point: str = "Điểm"
    refusal: str = "This question is outside the documents' domain."
    no_context: str = "No matching information was found in the documents."
    not_found: str = "The documents do not say."
    extract_head: str = "The most relevant passages:"
    no_title: str = "untitled"
    default_source: str = "document"
    reasons: dict = field(default_factory=lambda: {"empty": "empty", "injection": "prompt_injection", "domain": "domain", "follow_up": "follow_up", "outside": "outside_domain"})
