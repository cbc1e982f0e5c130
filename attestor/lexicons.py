"""Word lists, weights and patterns that define the analysis' results."""

from __future__ import annotations

# --- fixed values: domains -------------------------------------------------------------------------------------
BLOCKED_DOMAINS = [
    "facebook.com", "instagram.com", "kwai.com", "news.google.com", "pinterest.com", "podcast.com.br", "reddit.com",
    "threads.net", "tiktok.com", "twitter.com", "x.com", "youtu.be", "youtube.com",
]
UNSUPPORTED_DOMAINS = ["facebook.com", "instagram.com", "linkedin.com", "tiktok.com", "twitter.com", "x.com"]
TRUSTED_DOMAINS = ["agenciabrasil.ebc.com.br", "bbc.com", "estadao.com.br", "folha.uol.com.br", "g1.globo.com", "oglobo.globo.com"]

# --- fixed values: page extraction -----------------------------------------------------------------------------
REMOVED_TAGS = [
    "script", "style", "iframe", "footer", "nav", "header", "aside", "figure", "figcaption", "form", "button", "input",
    "select", "svg", "canvas", "video", "audio", "noscript", "template",
]
#: (attribute, substring) pairs; an element that has one is removed.
REMOVED_ATTRIBUTES = [
    ("class", "ad-"), ("class", "-ad"), ("id", "google-ad"), ("class", "banner"), ("class", "popup"), ("class", "cookie"),
    ("class", "newsletter"), ("class", "paywall"), ("class", "subscription"), ("class", "related-"), ("class", "recommended"),
    ("class", "share-"), ("class", "social-share"), ("class", "comment"), ("class", "sidebar"),
]
CRAWL_REMOVED_TAGS = ["script", "style", "noscript", "nav", "footer", "header", "aside", "form", "button", "iframe", "svg"]
CRAWL_TEXT_TAGS = ["h1", "h2", "h3", "p", "li"]
BLOCK_TAGS = ["p", "h2", "h3", "h4", "blockquote", "li"]
#: Ancestors' class parts and paragraph classes of portals, tried in this order when semantic roots give too little.
PORTAL_PARAGRAPHS = [
    ("self", "content-text__container"), ("above", "mc-article-body"), ("above", "mc-column"), ("above", "wall"),
    ("above", "protected-content"), ("self", "article__text"), ("above", "article-body"), ("above", "story-body"),
    ("above", "mat-body"), ("above", "news-body"), ("above", "entry-content"), ("above", "post-content"),
]
SCRIPT_SIGNALS = ["__NEXT_DATA__", "__NUXT__", "window.__STATE__", "ng-version", '<div id="app">', '<div id="root">']
PAYWALL_SIGNALS = [
    "assine para continuar", "conteúdo exclusivo para assinantes", "subscribe to continue",
    "this content is for subscribers", "acesso restrito", "conteúdo bloqueado",
]

# --- fixed values: linguistic markers (accents folded) ----------------------------------------------------------
SENSATIONALISM = [
    "absurdo", "assustador", "bizarro", "bomba", "bombastico", "caos", "chocante", "desesperador", "escandalo",
    "estarrecedor", "explosivo", "imperdivel", "inacreditavel", "incrivel", "nunca visto", "segredo", "surpreendente",
    "urgente", "viral", "viralizou",
]
EMOTIONAL = [
    "agonia", "ameaca", "assusta", "assustou", "choque", "destruiu", "devastador", "dor", "furia", "humilhacao",
    "indignacao", "medo", "odio", "panico", "revolta", "sofrimento", "terror", "tragedia", "vergonha",
]
CLICKBAIT = [
    "clique aqui", "compartilhe antes", "entenda o que aconteceu", "isso vai mudar", "nao querem que voce saiba",
    "nao vao te contar", "o que ninguem contou", "saiba agora", "veja antes que apaguem", "veja o que aconteceu",
    "veja o video", "veja por que", "voce nao vai acreditar",
]
SUBJECTIVE = [
    "acho", "acredito", "aparentemente", "claramente", "evidentemente", "lamentavel", "na minha opiniao", "parece",
    "provavelmente", "sem duvida", "supostamente", "talvez",
]
ABSOLUTE = ["com certeza", "definitivamente", "jamais", "nunca", "prova definitiva", "sempre", "todos sabem", "verdade absoluta"]
WEAK_ATTRIBUTION = [
    "circula nas redes", "dizem que", "fontes dizem", "informacoes preliminares", "internautas afirmam",
    "segundo publicacoes", "sem confirmacao", "suposta", "suposto", "teria acontecido", "teria sido",
]
SOURCE_ATTRIBUTION = [
    "afirmou", "apontou", "comunicou", "confirmou", "de acordo com", "declarou", "disse", "em nota", "informou",
    "levantamento", "pesquisa", "relatorio", "segundo",
]
DATA_TERMS = ["balanco", "censo", "dados", "estatistica", "indice", "levantamento", "pesquisa", "relatorio", "serie historica", "taxa"]
RISK_WEIGHTS = {
    "sensationalism": 0.24, "emotional_language": 0.18, "clickbait": 0.18, "punctuation_excess": 0.10,
    "uppercase_excess": 0.08, "subjectivity": 0.12, "weak_attribution": 0.10,
}

# --- fixed values: stance ---------------------------------------------------------------------------------------
NEGATION = [
    "falsa", "falso", "improcedente", "incorreta", "incorreto", "jamais", "mentira", "nao", "nega", "negado", "negam",
    "negou", "nunca", "sem",
]
CONTRADICTION = [
    "boato", "desinformacao", "desmente", "desmentem", "desmentido", "desmentiu", "diferente", "enganosa", "enganoso",
    "fake", "falsa", "falso", "imprecisa", "impreciso", "incorreta", "incorreto", "inveridica", "inveridico", "mentira",
    "nega", "negou", "refuta", "refutou",
]
CONTRADICTION_PHRASES = [
    "afirmacao falsa", "alegacao falsa", "conteudo enganoso", "conteudo falso", "e boato", "e falsa", "e falso",
    "informacao enganosa", "informacao falsa", "nao e verdade", "nao encontrou evidencia", "nao ha evidencia",
    "nao ha provas", "nao procede", "sem evidencia", "sem provas",
]
STANCE_STOPWORDS = [
    "a", "o", "os", "as", "um", "uma", "uns", "umas", "de", "da", "do", "das", "dos", "em", "no", "na", "nos", "nas",
    "por", "para", "com", "sem", "sobre", "entre", "ate", "apos", "durante", "que", "se", "ao", "aos", "e", "ou",
    "mas", "foi", "ser", "sao", "esta", "estao", "estar", "ter", "tem", "teve", "tambem", "segundo", "este", "esse",
    "essa", "isso", "aquele", "aquela", "como", "mais", "menos", "muito", "muita", "muitos", "muitas", "pela", "pelo",
    "pelos", "pelas", "sua", "seu", "suas", "seus",
]
FEATURE_STOPWORDS = [
    "a", "o", "os", "as", "um", "uma", "uns", "umas", "de", "da", "do", "das", "dos", "em", "no", "na", "nos", "nas",
    "por", "para", "com", "sem", "sob", "sobre", "entre", "que", "se", "ao", "aos", "e", "ou", "mas", "como", "mais",
    "menos", "muito", "muita", "muitos", "muitas", "foi", "ser", "sao", "esta", "estao", "ter", "tem", "teve",
    "tambem", "ja", "ainda", "esse", "essa", "isso", "este", "ele", "ela", "eles", "elas", "sua", "seu", "suas",
    "seus",
]
RETRIEVAL_STOPWORDS = [
    "a", "o", "as", "os", "um", "uma", "uns", "umas", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas",
    "por", "para", "com", "sem", "sob", "sobre", "entre", "ate", "até", "e", "ou", "mas", "que", "se", "ao", "aos",
    "sua", "seu", "suas", "seus", "foi", "ser", "ter", "tem", "tinha", "havia", "disse", "tambem", "também", "nesta",
    "neste", "desta", "deste", "essa", "esse", "isso", "como", "apos", "após", "pelo", "pela", "pelos", "pelas",
    "mais", "menos",
]
QUERY_STOPWORDS = [
    "o", "a", "os", "as", "um", "uma", "uns", "umas", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas",
    "por", "para", "com", "sem", "sob", "que", "se", "não", "mas", "e", "ou", "já", "ainda", "mais", "menos", "muito",
    "pouco", "todo", "toda", "segundo", "afirmou", "disse", "declarou", "informou", "também", "além", "disso", "isso",
    "aquilo", "este", "esta", "esse", "essa", "esses", "essas", "eles", "elas",
]
LIGHT_STOPWORDS = [
    "a", "o", "as", "os", "um", "uma", "uns", "umas", "de", "da", "do", "das", "dos", "em", "na", "no", "nas", "nos",
    "por", "para", "com", "que", "se", "ao", "à", "às", "aos", "e", "ou", "mas", "também", "já", "ainda", "muito",
    "mais", "isso", "este", "esta", "esse", "essa", "aquele", "aquela", "sobre", "entre", "quando", "onde", "como",
    "ser", "ter", "foi", "são", "está", "estão", "era", "eram",
]
JOURNAL_STOPWORDS = [
    "afirmou", "disse", "declarou", "informou", "relatou", "explicou", "destacou", "ressaltou", "apontou",
    "acrescentou", "afirma", "diz", "declara", "informa", "relata", "aponta", "segundo", "conforme", "portal",
    "redação", "agência", "correspondente", "g1", "uol", "folha", "globo", "estadão", "veja", "r7", "record", "sbt",
    "band", "hoje", "ontem", "semana", "mês", "ano", "passado", "próximo", "anterior", "recente", "recentemente",
]
WEAK_TOKENS = [
    "acordo", "afirma", "aponta", "brasil", "dados", "desta", "deste", "disse", "divulgada", "divulgado", "estudo",
    "fonte", "informa", "jornal", "levantamento", "mostra", "nesta", "neste", "noticia", "numero", "pesquisa",
    "portal", "publicada", "publicado", "relatorio", "resultado", "resultados", "segundo", "site", "tambem",
    "valores",
]
NUMERIC_CONTEXT = [
    "aumento", "bilhao", "bilhoes", "casos", "confianca", "crescimento", "entrevistados", "erro", "habitantes",
    "intencao", "intencoes", "margem", "milhao", "milhoes", "mortes", "municipios", "nivel", "percentuais",
    "percentual", "pessoas", "pontos", "porcentagem", "preco", "queda", "reducao", "valor", "valores", "voto",
    "votos",
]
SPECIFIC_TERMS = {
    "rejeicao": ["rejeicao", "nao votaria", "rejeita", "rejeitam"],
    "registro": ["registrada", "registrado", "registro", "protocolo", "identificada", "identificado"],
    "margem": ["margem de erro", "pontos percentuais", "nivel de confianca"],
    "votos_validos": ["votos validos"],
    "segundo_turno": ["segundo turno", "2º turno", "2o turno"],
    "primeiro_turno": ["primeiro turno", "1º turno", "1o turno"],
}
LAYER_WEIGHTS = {
    "vector_store": 1.00, "factcheck": 0.95, "web_search": 0.70, "tavily_search": 0.68, "serp_search": 0.68, "gdelt": 0.80,
    "newsapi": 0.80, "crawlee_search": 0.75, "ai_fallback": 0.70, "wikipedia": 0.20,
}
LAYER_ORDER = [
    "vector_store", "factcheck", "web_search", "tavily_search", "serp_search", "gdelt", "crawlee_search", "ai_fallback", "wikipedia",
]
#: Searches a day that a web layer may make.
DAILY_LIMITS = {"tavily_search": 80, "serp_search": 80, "gdelt": 40, "newsapi": 80, "web_search": 80, "crawlee_search": 40, "ai_fallback": 20}

# --- fixed values: abbreviations, in the order in which they are expanded -----------------------------------------
ABBREVIATIONS = {
    "sp": "São Paulo", "rj": "Rio de Janeiro", "df": "Distrito Federal", "pm": "Polícia Militar", "pc": "Polícia Civil",
    "mp": "Ministério Público", "stf": "Supremo Tribunal Federal", "stj": "Superior Tribunal de Justiça",
    "tcu": "Tribunal de Contas da União", "pib": "Produto Interno Bruto", "ipca": "índice de preços ao consumidor",
    "sus": "Sistema Único de Saúde", "onu": "Organização das Nações Unidas", "eua": "Estados Unidos", "ue": "União Europeia",
}

# --- fixed values: sentence signals of the regex detector; alternatives, matched as whole words ---------------------
SOCIAL_OPENINGS = ["bom dia", "boa tarde", "boa noite", "olá", "oi ", "obrigado", "parabéns"]
IMPERATIVE_OPENINGS = [
    "veja", "leia", "acesse", "confira", "saiba", "clique", "assista", "ouça", "baixe", "compartilhe", "participe", "vote",
    "siga", "curta", "inscreva",
]
OPINION_OPENINGS = ["acho", "acredito", "penso", "na minha opinião", "ao meu ver"]
UNITS = [
    "%", "mil", "bilhões?", "milhões?", "kg", "km", "m²", "ha", "anos?", "meses?", "dias?", "pontos?", "reais?", "dólares?",
    "euros?", "habitantes?", "mortos?", "casos?", "vagas?",
]
ATTRIBUTION_VERBS = [
    "disse", "afirmou", "declarou", "anunciou", "confirmou", "negou", "alegou", "informou", "comunicou", "revelou", "admitiu",
    "garantiu", "prometeu", "assegurou",
]
CAUSAL = ["causou", "gerou", "resultou em", "levou a", "provocou", "devido a", "por causa de", "em consequência", "como resultado de"]
COMPARATIVE = [
    "maior", "menor", "mais", "menos", "superior", "inferior", "dobro", "metade", "cresceu", "caiu", "aumentou", "reduziu",
    "superou", "ultrapassou",
]
COMPARED = ["que", "do que", "em relação", "comparado"]
DEFINITION = ["é definido como", "consiste em", "refere-se a", "significa", "corresponde a", "trata-se de", "é considerado"]
PREDICTION = ["deve", "deverá", "vai", "irá", "prevê", "projeta", "estima"]
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
FACTUAL_VERBS = [
    "ocorreu", "aconteceu", "registrou", "atingiu", "alcançou", "completou", "iniciou", "terminou", "aprovou", "rejeitou", "sancionou",
]
NEGATED_FACTS = ["não houve", "nunca foi", "jamais", "não existe", "não há", "não ocorreu", "não registrou"]
#: Hundredths that a signal adds.
SIGNAL_WEIGHTS = {
    "numeric": 50, "attribution": 50, "causal": 45, "comparative": 45, "definition": 40, "prediction": 40, "date": 20,
    "proper_noun": 15, "factual_verb": 20, "negation": 15, "quantity": 15,
}
EMPTY_ADJECTIVES = [
    "grande", "pequeno", "importante", "relevante", "significativo", "notável", "especial", "específico", "determinado", "certo",
    "possível", "necessário",
]
DOMAIN_KEYWORDS = [
    "inflação", "pib", "desemprego", "economia", "saúde", "educação", "segurança", "crime", "violência", "eleição",
    "governo", "presidente", "ministro", "congresso", "senado", "câmara", "lei", "decreto", "reforma", "orçamento",
    "dívida", "juros", "pandemia", "vacina", "covid", "clima", "ambiente", "energia", "petróleo", "exportação",
    "importação", "comércio", "dólar", "real", "bolsa", "mercado", "emprego", "salário", "renda", "pobreza",
    "desigualdade", "mortalidade", "natalidade", "população", "censo", "pesquisa", "estudo", "relatório",
]

# --- fixed values: sentence signals of the engine detector ---------------------------------------------------------
QUESTION_WORDS = ["quem", "o que", "quando", "onde", "como", "por que", "qual", "será", "poderia", "deveria", "pode", "existe", "há", "tem"]
CALL_STEMS = [
    "veja", "leia", "saiba", "clique", "acesse", "confira", "assine", "siga", "ouça", "compartilhe", "comente", "curta", "baixe",
    "instale", "atualiz",
]
OPINION_MARKERS = [
    "acho", "acha", "acredito", "acredita", "penso", "pensa", "na minha", "na minha opinião", "em minha", "parece", "ao meu ver",
    "ao nosso ver", "é possível que", "talvez", "provavelmente", "aparentemente", "supostamente", "seria", "poderia ser",
    "pode ser que", "é provável", "improvável",
]
CITATION_VERBS = [
    "afirmou", "disse", "declarou", "informou", "relatou", "explicou", "destacou", "ressaltou", "apontou", "alegou", "garante",
    "nega", "confirmou", "desmentiu", "revelou", "admitiu", "reconheceu", "anunciou", "prometeu", "defendeu",
]
FACTUAL_WORDS = [
    "estudo", "pesquisa", "levantamento", "relatório", "dado", "índice", "decreto", "portaria", "resolução", "medida", "aprovado",
    "sancionado", "publicado", "registrado", "comprovado", "inaugurado", "lançado", "eleito", "nomeado", "demitido", "preso",
    "morreu", "nasceu", "fundado", "criado", "extinto",
]
