"""City corrections as literal updates: (condition, city, state), written apart from the library's rules."""

# --- Fixed values: one update a row, in this order; each works on the result of those before ----
UPDATES = [
    ("seller_city ILIKE '%ao paulo' AND st = 'sp'", "sao paulo", None),
    ("seller_city ILIKE '%angra dos reis%' AND st = 'rj'", "angra dos reis", None),
    ("seller_city ILIKE '%porto seguro%' AND st = 'ba'", "porto seguro", None),
    ("seller_city ILIKE '%minas gerais%' AND st = 'mg'", "minas gerais", None),
    ("seller_city ILIKE '%auriflama%' AND st = 'sp'", "auriflama", None),
    ("seller_city ILIKE '%aguas claras%'", "aguas claras", "DF"),
    ("seller_city ILIKE '%andradas%'", None, "MG"),
    ("seller_city ILIKE '%ao bernardo do campo%'", "São Bernardo do Campo", "SP"),
    ("seller_city ILIKE '%camboriu%' AND st = 'sc'", "Balneário Camboriú", None),
    ("seller_city ILIKE '%belo horizont%'", "Belo Horizonte", "MG"),
    ("seller_city ILIKE '%rasilia%' AND st = 'df'", "Brasilia", None),
    ("seller_city ILIKE '%cariacica%' AND st = 'es'", "cariacica", None),
    ("seller_city ILIKE '%caxias do sul%'", "caxias do sul", "RS"),
    ("seller_city ILIKE '%chapeco%'", "chapeco", "SC"),
    ("seller_city ILIKE '%curitiba%'", "curitiba", "PR"),
    ("seller_city ILIKE '%ferraz de  vasconcelos%' AND st = 'sp'", "ferraz de  vasconcelos", None),
    ("seller_city ILIKE '%ipira%'", None, "SC"),
    ("seller_city ILIKE '%itajai%'", None, "SC"),
    ("seller_city ILIKE '%jaguariuna%'", None, "SP"),
    ("seller_city ILIKE '%jacutinga%'", None, "MG"),
    ("seller_city ILIKE '%juiz de fora%'", None, "MG"),
    ("seller_city ILIKE '%lages%' AND st = 'sc'", "lages", None),
    ("seller_city ILIKE '%londrina%'", None, "PR"),
    ("seller_city ILIKE '%marechal candido rondon%'", None, "PR"),
    ("seller_city ILIKE '%mogi das cruses%' AND st = 'sp' OR seller_city ILIKE '%mogi das cruzes%'", "mogi das cruzes", None),
    ("seller_city ILIKE '%novo hamburgo%' AND st = 'rs'", "novo hamburgo", None),
    ("seller_city ILIKE '%palhoca%'", None, "SC"),
    ("seller_city ILIKE '%pinhalzinho%'", None, "SC"),
    ("seller_city ILIKE '%porto alegre%'", None, "RS"),
    ("ct = 'ribeirao pretp' AND st = 'sp'", "ribeirao preto", None),
    ("seller_city ILIKE '%rio bonito%'", None, "RJ"),
    ("seller_city ILIKE '%rio de janeiro%'", None, "RJ"),
    ("seller_city ILIKE '%rio de janeiro%'", "rio de janeiro", None),
    ("ct = 's jose do rio preto'", "São José do Rio Preto", None),
    ("ct IN ('santa barbara d oeste', 'santa barbara d''oeste', 'santa bárbara d''oeste') AND st = 'sp'", "Santa Bárbara d'Oeste", None),
    ("ct = 'sao jose do rio pret' OR ct = 'são josé do rio preto' AND st = 'sp'", "sao jose do rio preto", None),
    ("ct IN ('sao jose dos pinhais', 'sao jose dos pinhas')", "São José dos Pinhais", "PR"),
    ("ct = 'sao miguel d''oeste' AND st = 'sc'", "sao miguel do oeste", None),
    ("ct IN ('sao paluo', 'sao paulo', 'sao paulo - sp', 'sao paulo sp', 'sao paulop') OR ct = 'sao pauo' AND st = 'sp'", "são paulo", None),
    ("ct = 'sbc'", "São Bernardo do Campo", None),
    ("ct = 'sp' OR ct = 'sp / sp' AND st = 'sp'", "são paulo", None),
    ("ct = 'volta redonda'", None, "RJ"),
]
# --- End of fixed values ------------------------------------------------------------------------
