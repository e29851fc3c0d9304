"""Fixed values that results depend on: patterns, lists, names and numbers, in their natural order."""

from __future__ import annotations

# --- Fixed values: cleaning ---------------------------------------------------
MIN_SOURCE_WORDS, MIN_TARGET_WORDS = 10, 5

MONTHS = r"(?:janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)"
DATED_CITIES = r"(?:joão pessoa|campina grande|guarabira|patos|monteiro|sousa)"

#: (rule, pattern, replacement, flags): i ignores case, s lets a dot match line ends.
CLEANING_RULES = (
    ("html_tags", r"<[^>]+>", " ", ""),
    ("metadados_processuais", r"(?:processo|protocolo|autos)[\s\w]*n[º°o]?[\s:]*[\d\.\-]+(?:/\d+)?", " ", "i"),
    ("ids_pje", r"\(?id[\s.]*[\s:]*\d{5,}\)?", " ", "i"),
    ("dje_carimbo_longo", r"(?:Data de Julgamento.*?|PROCESSO ELETRÔNICO.*?DJe[\w\-\s/]*(?:\d{4})?)", " ", "i"),
    ("dje_simples", r"\bDJe[\-\s]*[s/n]*\b", " ", "i"),
    ("dje_data", r"DJe\s+\d{1,2}[./]\d{1,2}[./]\d{2,4}", " ", "i"),
    ("divulg_isolado", r"\bDIVULG\b", " ", "i"),
    ("acp_dpu", r"Ação Civil Pública[\s\-]+ACP\s*n[º°o]?\s*[\d\.\-]+[^.]*DPU", " ", "i"),
    ("data_cidade", DATED_CITIES + r"[\s,]+\d{1,2}[\sde]+" + MONTHS + r"[\sde]+\d{4}", " [DATA] ", "i"),
    ("sumula_julgamento_duplicada", r"S[úu]mula\s+d[eo]\s+julgamento\s+(?=(?:\d+\.\s*)?S[úu]mula\s+d[eo]\s+julgamento\s*:)", " ", "is"),
    ("sumula_julgamento", r"(?:^|[\n\r]|[.;:]\s+|\s{2,}|[\xa0]+)(?:\d+\.\s*)?S[úu]mula\s+d[eo]\s+julgamento(?:\s*:\s*.*|\s*)$", " ", "is"),
    (
        "assinatura_magistrado_nome_titulo",
        r"(?:^|[\n\r]|[.;:]\s+|\s{2,}|[\xa0]+)(?:(?:[A-ZÀ-Ý]{2,}|[A-ZÀ-Ý][a-zà-ÿ]+)"
        r"(?:[\s\xa0]+(?:(?:[A-ZÀ-Ý]{2,}|[A-ZÀ-Ý][a-zà-ÿ]+)|da|de|do|dos|das|e)){2,7})[\s\xa0]+"
        r"(?:(?i:Ju[ií]z(?:a)?(?:[\s\xa0]+Federal)?(?:[\s\xa0]+Relator(?:a)?)?"
        r"|Relator(?:a)?|Desembargador(?:a)?(?:[\s\xa0]+Federal)?|Excelent[ií]ssimo(?:a)?))\.?[\s\xa0]*$",
        " ", "",
    ),
    ("honorificos_juiz", r"(?:Juiz Federal|Juíza Federal|Relator|Relatora|Excelentíssimo|Desembargador)[\w\s]*?$", " ", "i"),
    ("capslock_assinatura", r"\.?[ \n\r\t\xa0]*(?:[A-ZÀ-Þ]{2,}[ \n\r\t\xa0]+){2,}[A-ZÀ-Þ]{2,}[ \n\r\t\xa0]*$", " ", ""),
)

# --- Fixed values: masking ----------------------------------------------------
MIN_SOURCE_CHARS, MIN_TARGET_CHARS = 50, 20

CPF = r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"
CNPJ = r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b"
NPU = r"\b\d{7}-\d{2}\.\d{4}\.\d{1,2}\.\d{2}\.\d{4}\b"
ACCOUNT = r"(?:conta\s*(?:corrente|poupança|bancária)?|ag[êe]ncia|ag\.?|c/c|c\.c\.)\s*(?:n[º°o]?\s*)?\d{4,5}-\d\b"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE = r"(?:\(\d{2}\)\s*\d{4,5}-?\d{4}|\d{2}\s+\d{4,5}-\d{4})\b"
HONORIFICS = r"(?:Sr\.|Sra\.|Dr\.|Dra\.|advogado|advogada|autor|autora|réu|ré|perito|perita)"
HONORIFIC_NAME = r"\b(" + HONORIFICS + r")\s+([A-ZÀ-Ÿ][a-zà-ÿ]+\s*){1,4}[A-ZÀ-Ÿ][a-zà-ÿ]+\b"
CONTEXT_NAME = (
    r"(?<prefixo>\b(?:AUTOR(?:A)?\s*:|movid[oa]\s+por|representad[oa]\s+por|Sr\(a\)\.)\s*)"
    r"(?<nome>[A-ZÀ-Ý]{2,}(?:\s+[A-ZÀ-Ý]{2,}){1,6}?)"
    r"(?=\s*(?:R[ÉE]U\s*:|I(?:\.\d+)?\)|QUESTÕES\s+DO\b|ESPECIALIDADE\s*:|IDADE\s*:|"
    r"DATA(?:\s+DA\s+REALIZAÇÃO)?\s*:|em\s+face\b|por\s+intermédio\b|/|,|;|\.|\)|$))"
)
CONTEXT_MARKERS = ("AUTOR:", "AUTORA:", "movido por", "movida por", "representado por", "representada por", "Sr(a).")
PROPER_NAME = r"\b([A-ZÀ-Ÿ][a-zà-ÿ]+\s+){2,5}[A-ZÀ-Ÿ][a-zà-ÿ]+\b"
ADDRESS = (
    r"\b(?:rua|r\.|avenida|av\.|praça|pça\.|travessa|tv\.|rodovia|br-\d+|sítio|fazenda)"
    r"[^.,]{1,60}?(?:n[º°o]?\s*\d+|cep\s*\d|bloco\s*\d|lote\s*\d)"
)
PROTECTED_PREFIXES = (
    "Superior Tribunal", "Supremo Tribunal", "Tribunal Regional", "Tribunal de Justiça", "Turma Nacional",
    "juizado especial", "Juizado Especial", "Juizados Especiais", "Conselho Nacional", "Instituto Nacional",
    "Ministério Público", "Defensoria Pública", "Advocacia Geral", "Procuradoria Geral", "Caixa Econômica",
    "Banco Central", "Banco do Brasil", "Código de Processo", "Código Civil", "Código Penal", "Consolidação das Leis",
    "Constituição Federal", "Lei de Benefícios", "Lei Orgânica", "Regime Geral", "Fundo de Garantia",
    "Benefício de Prestação", "Recurso Cível", "Recurso Especial", "Recurso Extraordinário", "Embargos de Declaração",
    "Mandado de Segurança", "Ação Civil Pública", "Ação Penal", "Projeto de Lei", "Medida Provisória",
)
MASK_CPF, MASK_CNPJ, MASK_NPU, MASK_ACCOUNT = "[CPF]", "[CNPJ]", "[NPU]", "[CONTA-DIGITO]"
MASK_EMAIL, MASK_PHONE, MASK_ADDRESS = "[EMAIL]", "[TELEFONE]", "[ENDEREÇO_COMPLETO]"
MASK_HIDDEN_NAME, MASK_NAME = "[NOME_OCULTADO]", "[NOME_PESSOA]"

# --- Fixed values: audit ------------------------------------------------------
AUDIT_PATTERNS = (
    ("1. CPF", CPF, ""),
    ("2. CNPJ", CNPJ, ""),
    ("3. NPU (Número do Processo)", NPU, ""),
    ("4. ID PJe", r"\bid[\s.]*[\s:]*\d{5,}", "i"),
    ("5. E-mail", EMAIL, ""),
    ("6. Telefone", PHONE, ""),
    ("7. DJe com data residual", r"\bDJe\s+\d{1,2}[./]\d{1,2}[./]\d{2,4}", "i"),
)
AUDIT_NAMES = "8. Nomes privados"
AUDIT_HONORIFICS = ("Sr.", "Sra.", "Dr.", "Dra.", "advogado", "advogada", "réu", "ré", "perito", "perita")
AUDIT_HONORIFIC_NAME = (
    r"(?i:\b(?:(?:Sr\.|Sra\.|Dr\.|Dra\.|advogado|advogada|réu|ré|perito|perita)))\s+"
    r"([A-ZÀ-Ÿ][a-zà-ÿ]+(?:\s+[A-ZÀ-Ÿ][a-zà-ÿ]+){1,5})\b"
)

# --- Fixed values: profile ----------------------------------------------------
PERCENTILES = (0.05, 0.25, 0.75, 0.95)
CONTAMINATED_SOURCE = "VOTO-EMENTA"
TRUNCATED_TARGET = "AMPARO ASSISTENCIAL. SENTENÇA DE IMPROCEDÊNCIA. RECORRE A PARTE-AUTORA"
INSTITUTIONAL_HEADER = "JUSTIÇA FEDERAL DA 5ª REGIÃO"
LONG_TARGET_WORDS = 300
MAX_INPUT_TOKENS = 8192
TERM_STRIP = ".,;:!?()[]{}\"'/—–-"
STOP_WORDS = tuple(
    """a à ao aos as às até com como da das de del dem des do dos e é ela elas ele eles em entre era essa essas esse esses
    esta estar estas este estes eu foi for foram há isso isto já lhe lhes lo mas me mesmo meu minha muito na nas não nem no
    nos nós num numa o os ou para pela pelas pelo pelos por qual quando que quem são se sem ser seu seus sua suas só também
    te tem ter tu tua um uma uns umas você vos
    [nome_pessoa] [nome_ocultado] [cpf] [cnpj] [npu] [email] [telefone] [conta-digito] [endereço_completo] [data]
    nome_pessoa nome_ocultado cpf cnpj npu email telefone conta-digito endereço_completo data
    nº n° art art. inc inc. cf § ii iii iv vi vii viii ix sob""".split()
)
TOPIC_RULES = (
    ("Previdenciário", ("PREVIDENCI", "REVIDENCIÁRIO", "APOSENTADORIA", "PENSÃO POR MORTE", "AUXÍLIO", "SALÁRIO-MATERNIDADE", "REVISÃO DA RMI", "BENEFÍCIO POR INCAPACIDADE")),
    ("Assistencial", ("ASSISTENCIAL", "AMPARO", "BPC", "BENEFÍCIO ASSISTENCIAL", "ASSISTÊNCIA SOCIAL", "BENEFÍCIO DE PRESTAÇÃO CONTINUADA")),
    ("Seguridade Social", ("SEGURIDADE",)),
    ("Processual", ("PROCESSUAL", "AGRAVO", "ADEQUAÇÃO", "RECURSO ORDINÁRIO", "RECURSO INOMINADO", "QUESTÃO DE ORDEM", "RETORNO DOS AUTOS")),
    ("Administrativo", ("ADMINISTRATIV", "SERVIDOR PÚBLICO", "SAÚDE")),
    ("FGTS", ("FGTS",)),
    ("Embargos", ("EMBARGO",)),
    ("Civil", ("CIVIL",)),
    ("Tributário", ("TRIBUTÁRI", "FISCAL")),
    ("Criminal", ("PENAL", "CRIMINAL")),
    ("Constitucional", ("CONSTITUCIONAL",)),
    ("Financeiro/Habitacional", ("FINANCIAMENTO HABITACIONAL", "SISTEMA FINANCEIRO")),
)
OTHER_TOPIC = "Outros"

# --- Fixed values: chat records -----------------------------------------------
MARKER = "Gere a ementa para a seguinte fundamentação:\n"
JUDGE_SOURCE_HEADING, JUDGE_TARGET_HEADING = "Fundamentação original:\n", "Ementa candidata:\n"

# --- Fixed values: evaluation -------------------------------------------------
TEST_SHARE = 0.10
CONDITIONS = (
    ("gemini_ft", "Gemini 2.5 Flash", "gemini", "fine_tuned"),
    ("gemini_zero_shot", "Gemini 2.5 Flash", "gemini", "zero_shot"),
    ("qwen_ft", "Qwen 2.5 14B-Instruct", "qwen", "fine_tuned"),
    ("qwen_zero_shot", "Qwen 2.5 14B-Instruct", "qwen", "zero_shot"),
)
CONDITION_IDS = tuple(c[0] for c in CONDITIONS)
JUDGE_DIMENSIONS = ("pertinencia_tematica", "completude_dispositiva", "fidelidade_factual", "concisao", "adequacao_terminologica")
HUMAN_CRITERIA = ("adequacao", "completude", "concisao", "fluencia")
SEED = 20260329
CASES_PER_STRATUM, STRATA, RATERS = 10, 4, 2
ITERATIONS = 10_000
ALPHA = 0.05
