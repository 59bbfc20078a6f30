"""Fixed values of the profile domain (Brazilian geography, occupations, vocabulary)."""

from __future__ import annotations

# State, its region, municipalities and area codes.
STATES: dict[str, tuple[str, tuple[str, ...], tuple[int, ...]]] = {
    "AC": ("Norte", ("Rio Branco", "Cruzeiro do Sul", "Sena Madureira"), (68,)),
    "AL": ("Nordeste", ("Maceió", "Arapiraca", "Palmeira dos Índios"), (82,)),
    "AP": ("Norte", ("Macapá", "Santana", "Laranjal do Jari"), (96,)),
    "AM": ("Norte", ("Manaus", "Parintins", "Itacoatiara"), (92, 97)),
    "BA": ("Nordeste", ("Salvador", "Feira de Santana", "Vitória da Conquista"), (71, 73, 74, 75, 77)),
    "CE": ("Nordeste", ("Fortaleza", "Juazeiro do Norte", "Sobral"), (85, 88)),
    "DF": ("Centro-Oeste", ("Brasília", "Ceilândia", "Taguatinga"), (61,)),
    "ES": ("Sudeste", ("Vitória", "Vila Velha", "Serra"), (27, 28)),
    "GO": ("Centro-Oeste", ("Goiânia", "Anápolis", "Aparecida de Goiânia"), (62, 64)),
    "MA": ("Nordeste", ("São Luís", "Imperatriz", "Caxias"), (98, 99)),
    "MT": ("Centro-Oeste", ("Cuiabá", "Várzea Grande", "Rondonópolis"), (65, 66)),
    "MS": ("Centro-Oeste", ("Campo Grande", "Dourados", "Três Lagoas"), (67,)),
    "MG": ("Sudeste", ("Belo Horizonte", "Uberlândia", "Contagem"), (31, 32, 33, 34, 35, 37, 38)),
    "PA": ("Norte", ("Belém", "Ananindeua", "Santarém"), (91, 93, 94)),
    "PB": ("Nordeste", ("João Pessoa", "Campina Grande", "Patos"), (83,)),
    "PR": ("Sul", ("Curitiba", "Londrina", "Maringá"), (41, 42, 43, 44, 45, 46)),
    "PE": ("Nordeste", ("Recife", "Olinda", "Caruaru"), (81, 87)),
    "PI": ("Nordeste", ("Teresina", "Parnaíba", "Picos"), (86, 89)),
    "RJ": ("Sudeste", ("Rio de Janeiro", "Niterói", "Petrópolis"), (21, 22, 24)),
    "RN": ("Nordeste", ("Natal", "Mossoró", "Parnamirim"), (84,)),
    "RS": ("Sul", ("Porto Alegre", "Caxias do Sul", "Pelotas"), (51, 53, 54, 55)),
    "RO": ("Norte", ("Porto Velho", "Ji-Paraná", "Ariquemes"), (69,)),
    "RR": ("Norte", ("Boa Vista", "Rorainópolis", "Caracaraí"), (95,)),
    "SC": ("Sul", ("Florianópolis", "Joinville", "Blumenau"), (47, 48, 49)),
    "SP": ("Sudeste", ("São Paulo", "Campinas", "Santos"), (11, 12, 13, 14, 15, 16, 17, 18, 19)),
    "SE": ("Nordeste", ("Aracaju", "Nossa Senhora do Socorro", "Lagarto"), (79,)),
    "TO": ("Norte", ("Palmas", "Araguaína", "Gurupi"), (63,)),
}
# Sampling weights and income multipliers of the regions.
REGIONS = {"Norte": (0.09, 0.90), "Nordeste": (0.27, 0.86), "Centro-Oeste": (0.08, 1.06), "Sudeste": (0.42, 1.14), "Sul": (0.14, 1.08)}
GENDERS = {"Feminino": 0.505, "Masculino": 0.485, "Outro": 0.010}
# Education levels with income multipliers, and marital statuses.
EDUCATION = {"Fundamental": 0.82, "Ensino Médio": 0.95, "Superior Incompleto": 1.05, "Superior Completo": 1.30, "Pós-graduação": 1.48}
MARITAL = ("Solteiro", "Casado", "União Estável", "Divorciado", "Viúvo")

# Of each occupation the number of the lowest education level, least age, income multiplier, sampling weight, and what departs from the defaults.
_OCCUPATIONS: dict[str, tuple[int, int, float, float, dict[str, float]]] = {
    "Estudante": (3, 18, 0.45, 0.72, {}),
    "Estagiário": (3, 18, 0.55, 0.62, {"max": 35.0}),
    "Serviços Gerais": (1, 18, 0.72, 1.05, {}),
    "Atendente": (1, 18, 0.78, 1.1, {}),
    "Operador de Caixa": (1, 18, 0.8, 0.9, {}),
    "Recepcionista": (2, 18, 0.86, 0.78, {}),
    "Vendedor": (1, 18, 0.95, 1.05, {}),
    "Auxiliar Administrativo": (2, 18, 0.9, 0.86, {}),
    "Motorista": (1, 21, 1.0, 0.8, {}),
    "Entregador": (1, 18, 0.9, 0.74, {}),
    "Agricultor": (1, 18, 0.95, 0.62, {}),
    "Pedreiro": (1, 18, 1.05, 0.62, {}),
    "Eletricista": (2, 18, 1.12, 0.5, {}),
    "Mecânico": (2, 18, 1.12, 0.5, {"sigma": 0.36, "tail_p": 0.035, "tail_s": 0.26, "edu": 0.45, "exp": 0.62}),
    "Técnico": (2, 18, 1.05, 0.72, {}),
    "Técnico de Informática": (2, 18, 1.15, 0.62, {}),
    "Técnico de Enfermagem": (2, 18, 1.12, 0.52, {}),
    "Professor": (4, 22, 1.25, 0.55, {}),
    "Enfermeiro": (4, 22, 1.45, 0.42, {}),
    "Assistente Social": (4, 22, 1.2, 0.32, {}),
    "Designer": (3, 18, 1.2, 0.45, {}),
    "Desenvolvedor de Software": (3, 18, 1.65, 0.48, {}),
    "Analista": (3, 20, 1.35, 0.6, {}),
    "Analista de Dados": (3, 20, 1.7, 0.42, {}),
    "Analista Administrativo": (3, 20, 1.25, 0.48, {}),
    "Contador": (4, 22, 1.45, 0.32, {}),
    "Engenheiro": (4, 23, 1.85, 0.34, {"sigma": 0.43, "tail_p": 0.075, "tail_s": 0.36, "edu": 0.5, "exp": 0.68}),
    "Arquiteto": (4, 23, 1.65, 0.24, {}),
    "Advogado": (4, 23, 1.65, 0.32, {}),
    "Dentista": (4, 24, 2.1, 0.2, {"sigma": 0.46, "tail_p": 0.09, "tail_s": 0.4, "edu": 0.45, "exp": 0.7}),
    "Médico": (4, 25, 2.7, 0.22, {"sigma": 0.48, "tail_p": 0.1, "tail_s": 0.42, "edu": 0.42, "exp": 0.72}),
    "Coordenador": (4, 23, 1.65, 0.36, {}),
    "Gerente": (4, 25, 2.1, 0.28, {"sigma": 0.45, "tail_p": 0.08, "tail_s": 0.38, "edu": 0.48, "exp": 0.72}),
    "Diretor": (5, 30, 2.8, 0.1, {"sigma": 0.5, "tail_p": 0.12, "tail_s": 0.45, "edu": 0.35, "exp": 0.78}),
    "Autônomo": (1, 18, 1.05, 0.86, {"var": 1.22, "sigma": 0.54, "tail_p": 0.1, "tail_s": 0.42, "edu": 0.45}),
    "Microempreendedor": (1, 18, 1.2, 0.74, {"var": 1.28, "sigma": 0.56, "tail_p": 0.12, "tail_s": 0.44, "edu": 0.45}),
    "Aposentado": (1, 50, 0.85, 0.35, {}),
}
# What an occupation has unless it says otherwise.
DEFAULTS = {"max": 999.0, "var": 1.0, "loc": 1.0, "sigma": 0.42, "tail_p": 0.06, "tail_s": 0.32, "edu": 0.65, "exp": 0.55}

OCCUPATIONS: dict[str, dict[str, float]] = {
    name: DEFAULTS | {"level": float(level), "min": float(age), "mult": multiplier, "weight": weight} | own for name, (level, age, multiplier, weight, own) in _OCCUPATIONS.items()
}
# Occupations that profit from a postgraduate degree.
POSTGRADUATE_BOOST = ("Professor", "Analista de Dados", "Engenheiro", "Médico", "Dentista", "Advogado", "Coordenador", "Gerente", "Diretor")

# Spellings without accents that older data holds, all of them category values of today without their accents.
ALIASED = (
    "Ensino Médio", "Pós-graduação", "União Estável", "Viúvo", "Serviços Gerais", "Técnico", "Autônomo", "Maceió", "Palmeira dos Índios",
    "Macapá", "Vitória da Conquista", "Brasília", "Ceilândia", "Vitória", "Goiânia", "Anápolis", "Aparecida de Goiânia", "São Luís", "Cuiabá",
    "Várzea Grande", "Rondonópolis", "Três Lagoas", "Uberlândia", "Belém", "Santarém", "João Pessoa", "Maringá", "Parnaíba", "Niterói",
    "Petrópolis", "Mossoró", "Ji-Paraná", "Rorainópolis", "Caracaraí", "Florianópolis", "São Paulo", "Araguaína",
)
_PLAIN = str.maketrans("áâãéêíóôõúçÁÂÃÉÊÍÓÔÕÚÇ", "aaaeeioooucAAAEEIOOOUC")
ALIASES = {name.translate(_PLAIN): name for name in ALIASED}

# Names and order of the columns, presets, bounds and the reference date.
MODEL_COLUMNS = ("Idade", "Genero", "Regiao", "Estado", "Municipio", "Escolaridade", "Estado_Civil", "Ocupacao", "Renda", "Dependentes", "DDD")
FINAL_COLUMNS = (
    "Nome", "Genero", "Data_Nascimento", "Idade", "Regiao", "Estado", "Municipio", "DDD", "Telefone", "Escolaridade", "Estado_Civil",
    "Ocupacao", "Renda", "Dependentes", "CPF", "CNH", "RG", "Titulo_Eleitor",
)
IDENTIFIERS = ("CPF", "CNH", "RG", "Titulo_Eleitor", "Telefone")
PRESETS = {
    "completo": FINAL_COLUMNS,
    "demografico": ("Genero", "Data_Nascimento", "Idade", "Regiao", "Estado", "Municipio", "Escolaridade", "Estado_Civil", "Ocupacao", "Renda", "Dependentes"),
    "contato": ("Nome", "Regiao", "Estado", "Municipio", "DDD", "Telefone"),
    "documentos": ("Nome", "Data_Nascimento", "CPF", "CNH", "RG", "Titulo_Eleitor"),
    "minimo": ("Nome", "Idade", "Estado", "CPF"),
}
CATEGORIES = {
    "Genero": tuple(GENDERS), "Regiao": tuple(REGIONS), "Estado": tuple(STATES), "Municipio": tuple(c for s in STATES.values() for c in s[1]),
    "Escolaridade": tuple(EDUCATION), "Estado_Civil": MARITAL, "Ocupacao": tuple(OCCUPATIONS),
}
AGE, INCOME, DEPENDENTS = (18, 85), (800.0, 50000.0), (0, 6)
REFERENCE_DATE = "2026-07-26"

# Our own names for made-up people.
FIRST_NAMES = {
    "Feminino": "Ana,Beatriz,Carla,Daniela,Elisa,Fernanda,Helena,Julia,Larissa,Marina,Paula,Renata",
    "Masculino": "André,Bruno,Caio,Diego,Eduardo,Felipe,Gustavo,Hugo,Igor,João,Lucas,Rafael",
}
LAST_NAMES = "Almeida,Barbosa,Cardoso,Dias,Esteves,Ferreira,Gomes,Lima,Martins,Nogueira,Oliveira,Pereira,Ramos,Souza,Teixeira,Vieira"
