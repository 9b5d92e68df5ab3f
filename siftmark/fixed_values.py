"""Constants, word lists and text formats the results depend on.

Everything here has to equal the published method's value for results to
agree, so it is kept in one place, in plain text and in natural order.
"""

# ---------------------------------------------------------------- weights --
# The three weight families and their ordered keys.
TOPIC_KEYS = tuple(f"topic_{i}" for i in range(13))
DOMAIN_KEYS = ("arxiv", "book", "c4", "commoncrawl", "github", "stackexchange", "wikipedia")
QUALITY_KEYS = ("quality_0_1", "quality_1_2", "quality_2_3", "quality_3_4", "quality_4_5")

# Update constants.
INITIAL_WEIGHT = 10.0
ETA = 0.1
LOSS_SCALE = 0.5
S_SCALE = 0.6
S_DIVISOR = 100.0
COLLABORATION_BETA = 1.0
DECAY_LAMBDA = 0.1
TOP_N = 8_500_000

# -------------------------------------------------------------- annotation --
# Topic vocabulary of the annotator.
TOPIC_NAMES = (
    "General reference",
    "Culture and the arts",
    "Geography and places",
    "Health and fitness",
    "History and events",
    "Human activities",
    "Mathematics and logic",
    "Natural and physical sciences",
    "People and self",
    "Philosophy and thinking",
    "Religion and belief systems",
    "Society and social sciences",
    "Technology and applied sciences",
)
ANNOTATOR_MODEL = "gpt-4o-mini"
ANNOTATOR_TEMPERATURE = 0.1
ANNOTATOR_URL = "/v1/chat/completions"
ANNOTATOR_PROMPT = """
    You are an annotator tasked with analyzing the category distribution of web data. 
    For each provided full-text segment, select one topic from the following 13 provided topics that can best represents the primary topic of the text:
    {topics}
    Please respond with a JSON object in the following format:
    {{
    "topic": string, //summarize the topic of the provided document
    "selected topic": string //selected topic from the 13 topics:{topics}
    "explanation": string //explain why select the topic in this way
    }}
    """.format(topics=", ".join(TOPIC_NAMES))
CUSTOM_ID_PATTERN = r"task-cluster-(\d+)-rank-(\d+)"
CLUSTER_SAMPLE_SIZE = 10
CLUSTER_ROWS_PER_SAMPLE = 3000
CLUSTER_WINDOW = 100

# ---------------------------------------------------------------- matching --
# Subtasks per evaluation task.
SUBTASKS = {
    "mmlu": 1,
    "bbh": 27,
    "tydiqa": 9,
    "arc_challenge": 1,
    "arc_easy": 1,
    "boolq": 1,
    "commonsense_qa": 1,
    "hellaswag": 1,
    "openbookqa": 1,
    "race": 1,
    "sciq": 1,
    "social_iqa": 1,
    "winogrande": 1,
    "lambada": 1,
    "jeopardy": 1,
    "squad": 1,
}
PROJECTION_DIM = 8192
ADAM_BETA1 = 0.9
ADAM_BETA2 = 0.999
ADAM_EPS = 1e-08
NORM_EPS = 1e-12

# ------------------------------------------------------- text and sequences --
# Sequence geometry and ignore indexes.
SEQUENCE_LENGTH = 1024
SLICE_ROWS = 1250
IGNORE_INDEX = -100
PAD_TARGET = -1
VALIDATION_ROWS = 500

# Learning-rate schedule.
PEAK_LR = 1e-3
STABLE_ITERS = 400_000
WARMUP_ITERS = 16_000.0
DECAY_HALF_LIFE = 400

# Packed file format.
PACKED_MAGIC = b"LITPKDS"
PACKED_VERSION = 1
PACKED_HEADER_BYTES = 24
PACKED_DTYPES = {
    1: "uint8",
    2: "int8",
    3: "int16",
    4: "int32",
    5: "int64",
    6: "float32",
    7: "float64",
    8: "uint16",
}
PACKED_UINT16_VOCAB = 65500

# ----------------------------------------------------------------- prompts --
# Chat wrapping.
TULU_USER = "<|user|>\n"
TULU_ASSISTANT = "\n<|assistant|>\n"
ANSWER_LEAD = "The answer is:"
INST_OPEN = "<s> [INST] "
INST_CLOSE = " [/INST] "

# Instruction texts.
PASSAGE_INSTRUCTION = "Answer the following question based on the information in the given passage."
SENTENCE_INSTRUCTION = "Finish the following sentence based on the information."
LAST_WORD_INSTRUCTION = "Fill the last word based on the information."
DESCRIPTION_INSTRUCTION = "According to the description, give an one word answer."
MMLU_INSTRUCTION = "The following are multiple choice questions (with answers) about "

# Per-language instruction, passage tag, question tag, answer tag.
LANGUAGE_TEMPLATES = {
    "english": (PASSAGE_INSTRUCTION, "Passage:", "Question:", "Answer:"),
    "arabic": ("أجب على السؤال التالي بناءً على المعلومات في المقطع المعطى.", "المقطع:", "السؤال:", "الإجابة:"),
    "bengali": ("প্রদত্ত অধ্যায়ের তথ্যের উপর ভিত্তি করে নিম্নলিখিত প্রশ্নের উত্তর দিন।", "অধ্যায়:", "প্রশ্ন:", "উত্তর:"),
    "finnish": ("Vastaa seuraavaan kysymykseen annetun kappaleen tiedon perusteella.", "Kappale:", "Kysymys:", "Vastaus:"),
    "indonesian": ("Jawab pertanyaan berikut berdasarkan informasi di bagian yang diberikan.", "Bagian:", "Pertanyaan:", "Jawaban:"),
    "korean": ("주어진 문단의 정보에 기반하여 다음 질문에 답하십시오.", "문단:", "질문:", "답변:"),
    "russian": ("Ответьте на следующий вопрос на основе информации в данном отрывке.", "Отрывок:", "Вопрос:", "Ответ:"),
    "swahili": ("Jibu swali lifuatalo kulingana na habari kwenye kifungu kilichotolewa.", "Kifungu:", "Swali:", "Jibu:"),
    "telugu": ("ఇచ్చిన పేరాలోని సమాచారం ఆధారంగా కింది ప్రశ్నకు సమాధానం ఇవ్వండి.", "పేరా:", "ప్రశ్న:", "సమాధానం:"),
}
CHINESE_TEMPLATE = ("根据所给文章中的信息回答以下问题。", "文章:", "问题:", "答案:")
