"""The finished category dictionary, (Portuguese name, English name, main category)."""

CATEGORIES = [
    ("informatica_acessorios", "computers_accessories", "Electronics & Technology"),
    ("automotivo", "auto", "Construction tools ,arts & Others"),
    ("cama_mesa_banho", "bed_bath_table", "Home & Furniture"),
    ("moveis_decoracao", "furniture_decor", "Home & Furniture"),
    ("esporte_lazer", "sports_leisure", "Sports, Toys & Leisure"),
    ("perfumaria", "perfumery", "Beauty & Personal Care"),
    ("utilidades_domesticas", "housewares", "Home & Furniture"),
    ("telefonia", "telephony", "Electronics & Technology"),
    ("relogios_presentes", "watches_gifts", "Sports, Toys & Leisure"),
    ("alimentos_bebidas", "food_drink", "Sports, Toys & Leisure"),
    ("bebes", "baby", "Sports, Toys & Leisure"),
    ("papelaria", "stationery", "Construction tools ,arts & Others"),
    ("tablets_impressao_imagem", "tablets_printing_image", "Electronics & Technology"),
    ("brinquedos", "toys", "Sports, Toys & Leisure"),
    ("telefonia_fixa", "fixed_telephony", "Electronics & Technology"),
    ("ferramentas_jardim", "garden_tools", "Construction tools ,arts & Others"),
    ("fashion_bolsas_e_acessorios", "fashion_bags_accessories", "Fashion & Accessories"),
    ("eletroportateis", "small_appliances", "Electronics & Technology"),
    ("consoles_games", "consoles_games", "Electronics & Technology"),
    ("audio", "audio", "Electronics & Technology"),
    ("fashion_calcados", "fashion_shoes", "Fashion & Accessories"),
    ("cool_stuff", "cool_stuff", "Sports, Toys & Leisure"),
    ("malas_acessorios", "luggage_accessories", "Fashion & Accessories"),
    ("climatizacao", "air_conditioning", "Electronics & Technology"),
    ("construcao_ferramentas_construcao", "construction_tools_construction", "Construction tools ,arts & Others"),
    ("moveis_cozinha_area_de_servico_jantar_e_jardim", "kitchen_dining_laundry_garden_furniture", "Home & Furniture"),
    ("construcao_ferramentas_jardim", "costruction_tools_garden", "Construction tools ,arts & Others"),
    ("fashion_roupa_masculina", "fashion_male_clothing", "Fashion & Accessories"),
    ("pet_shop", "pet_shop", "Home & Furniture"),
    ("moveis_escritorio", "office_furniture", "Home & Furniture"),
    ("market_place", "market_place", "Construction tools ,arts & Others"),
    ("eletronicos", "electronics", "Electronics & Technology"),
    ("eletrodomesticos", "home_appliances", "Electronics & Technology"),
    ("artigos_de_festas", "party_supplies", "Sports, Toys & Leisure"),
    ("casa_conforto", "home_confort", "Home & Furniture"),
    ("construcao_ferramentas_ferramentas", "costruction_tools_tools", "Construction tools ,arts & Others"),
    ("agro_industria_e_comercio", "agro_industry_and_commerce", "Construction tools ,arts & Others"),
    ("moveis_colchao_e_estofado", "furniture_mattress_and_upholstery", "Home & Furniture"),
    ("livros_tecnicos", "books_technical", "Sports, Toys & Leisure"),
    ("casa_construcao", "home_construction", "Home & Furniture"),
    ("instrumentos_musicais", "musical_instruments", "Electronics & Technology"),
    ("moveis_sala", "furniture_living_room", "Home & Furniture"),
    ("construcao_ferramentas_iluminacao", "construction_tools_lights", "Construction tools ,arts & Others"),
    ("industria_comercio_e_negocios", "industry_commerce_and_business", "Construction tools ,arts & Others"),
    ("alimentos", "food", "Sports, Toys & Leisure"),
    ("artes", "art", "Construction tools ,arts & Others"),
    ("moveis_quarto", "furniture_bedroom", "Home & Furniture"),
    ("livros_interesse_geral", "books_general_interest", "Sports, Toys & Leisure"),
    ("construcao_ferramentas_seguranca", "construction_tools_safety", "Construction tools ,arts & Others"),
    ("fashion_underwear_e_moda_praia", "fashion_underwear_beach", "Fashion & Accessories"),
    ("fashion_esporte", "fashion_sport", "Fashion & Accessories"),
    ("sinalizacao_e_seguranca", "signaling_and_security", "Electronics & Technology"),
    ("pcs", "computers", "Electronics & Technology"),
    ("artigos_de_natal", "christmas_supplies", "Sports, Toys & Leisure"),
    ("fashion_roupa_feminina", "fashio_female_clothing", "Fashion & Accessories"),
    ("eletrodomesticos_2", "home_appliances_2", "Electronics & Technology"),
    ("livros_importados", "books_imported", "Sports, Toys & Leisure"),
    ("bebidas", "drinks", "Sports, Toys & Leisure"),
    ("cine_foto", "cine_photo", "Electronics & Technology"),
    ("la_cuisine", "la_cuisine", "Home & Furniture"),
    ("musica", "music", "Electronics & Technology"),
    ("casa_conforto_2", "home_comfort_2", "Home & Furniture"),
    ("portateis_casa_forno_e_cafe", "small_appliances_home_oven_and_coffee", "Home & Furniture"),
    ("cds_dvds_musicais", "cds_dvds_musicals", "Electronics & Technology"),
    ("dvds_blu_ray", "dvds_blu_ray", "Electronics & Technology"),
    ("flores", "flowers", "Sports, Toys & Leisure"),
    ("artes_e_artesanato", "arts_and_craftmanship", "Construction tools ,arts & Others"),
    ("fraldas_higiene", "diapers_and_hygiene", "Beauty & Personal Care"),
    ("fashion_roupa_infanto_juvenil", "fashion_childrens_clothes", "Fashion & Accessories"),
    ("seguros_e_servicos", "security_and_services", "Electronics & Technology"),
    ("beleza_saude", "health & beauty", "Beauty & Personal Care"),
    ("portateis_cozinha_e_preparadores_de_alimentos", "portable_kitchen_and_food_preparators", "Electronics & Technology"),
    ("pc_gamer", "pc_gamer", "Electronics & Technology"),
]

# (city, state) before and after the city corrections, worked out by hand.
CITIES = [
    (("sao paulo", "SP"), ("são paulo", "SP")),
    (("sao paulo", "RJ"), ("são paulo", "RJ")),
    (("sao pauo", "SP"), ("são paulo", "SP")),
    (("sao pauo", "RJ"), ("sao pauo", "RJ")),
    (("são paulo", "SP"), ("são paulo", "SP")),
    (("sp", "RJ"), ("são paulo", "RJ")),
    (("sp / sp", "RJ"), ("sp / sp", "RJ")),
    (("sbc", "SP"), ("São Bernardo do Campo", "SP")),
    (("sbc/sp", "SP"), ("sbc/sp", "SP")),
    (("s jose do rio preto", "SP"), ("sao jose do rio preto", "SP")),
    (("s jose do rio preto", "MG"), ("São José do Rio Preto", "MG")),
    (("sao jose dos pinhais", "SP"), ("São José dos Pinhais", "PR")),
    (("aguas claras df", "SP"), ("aguas claras", "DF")),
    (("ipira", "BA"), ("ipira", "SC")),
    (("ipiranga", "PR"), ("ipiranga", "SC")),
    (("mogi das cruses", "SP"), ("mogi das cruzes", "SP")),
    (("mogi das cruses", "RJ"), ("mogi das cruses", "RJ")),
    (("mogi das cruzes / sp", "RJ"), ("mogi das cruzes", "RJ")),
    (("RIO DE JANEIRO, brasil", "SP"), ("rio de janeiro", "RJ")),
    (("volta redonda", "SP"), ("volta redonda", "RJ")),
    (("belo horizont", "SP"), ("Belo Horizonte", "MG")),
    (("balneario camboriu", "SC"), ("Balneário Camboriú", "SC")),
    (("sao bernardo do capo", "SP"), ("sao bernardo do capo", "SP")),
    ((None, "SP"), (None, "SP")),
    (("santa barbara d oeste", "SP"), ("Santa Bárbara d'Oeste", "SP")),
    (("santa barbara d'oeste ", "sp"), ("Santa Bárbara d'Oeste", "sp")),
    (("sao miguel d'oeste", "SC"), ("sao miguel do oeste", "SC")),
    (("Ipirá", "BA"), ("Ipirá", "BA")),
    (("centro de sao paulo", "SP"), ("são paulo", "SP")),
    (("sao paulo - sp", "SP"), ("são paulo", "SP")),
]

# One pair for each correction, in the order of the corrections, that comes out differently without it.
ONE_EACH = [
    (("vila sao paulo", "SP"), ("são paulo", "SP")),
    (("angra dos reis rj", "RJ"), ("angra dos reis", "RJ")),
    (("arraial d'ajuda (porto seguro)", "BA"), ("porto seguro", "BA")),
    (("minas gerais - mg", "MG"), ("minas gerais", "MG")),
    (("Auriflama/SP", "sp"), ("auriflama", "sp")),
    (("aguas claras df", "SP"), ("aguas claras", "DF")),
    (("andradas", "SP"), ("andradas", "MG")),
    (("ao bernardo do campo", "RJ"), ("São Bernardo do Campo", "SP")),
    (("balneario camboriu", "SC"), ("Balneário Camboriú", "SC")),
    (("belo horizont", "SP"), ("Belo Horizonte", "MG")),
    (("BRASILIA df", "DF"), ("Brasilia", "DF")),
    (("cariacica / es", "ES"), ("cariacica", "ES")),
    (("caxias do sul, brasil", "SC"), ("caxias do sul", "RS")),
    (("chapeco sc", "RS"), ("chapeco", "SC")),
    (("curitiba - pr", "SP"), ("curitiba", "PR")),
    (("ferraz de  vasconcelos sp", "SP"), ("ferraz de  vasconcelos", "SP")),
    (("ipira", "BA"), ("ipira", "SC")),
    (("itajai", "sc "), ("itajai", "SC")),
    (("jaguariuna", "MG"), ("jaguariuna", "SP")),
    (("Jacutinga", "SP"), ("Jacutinga", "MG")),
    (("juiz de fora", "RJ"), ("juiz de fora", "MG")),
    (("lages - sc", "SC"), ("lages", "SC")),
    (("londrina", "SP"), ("londrina", "PR")),
    (("marechal candido rondon", "SC"), ("marechal candido rondon", "PR")),
    (("mogi das cruses", "SP"), ("mogi das cruzes", "SP")),
    (("novo hamburgo, rio grande do sul, brasil", "RS"), ("novo hamburgo", "RS")),
    (("palhoca", "SP"), ("palhoca", "SC")),
    (("pinhalzinho", "SP"), ("pinhalzinho", "SC")),
    (("porto alegre", "SP"), ("porto alegre", "RS")),
    (("ribeirao pretp", "SP"), ("ribeirao preto", "SP")),
    (("rio bonito", "SP"), ("rio bonito", "RJ")),
    (("rio de janeiro", "SP"), ("rio de janeiro", "RJ")),
    (("RIO DE JANEIRO, brasil", "RJ"), ("rio de janeiro", "RJ")),
    (("s jose do rio preto", "MG"), ("São José do Rio Preto", "MG")),
    (("santa barbara d oeste", "SP"), ("Santa Bárbara d'Oeste", "SP")),
    (("sao jose do rio pret", "SP"), ("sao jose do rio preto", "SP")),
    (("sao jose dos pinhas", "SP"), ("São José dos Pinhais", "PR")),
    (("sao miguel d'oeste", "SC"), ("sao miguel do oeste", "SC")),
    (("sao paulop", "SP"), ("são paulo", "SP")),
    (("sbc", "SP"), ("São Bernardo do Campo", "SP")),
    (("sp / sp", "SP"), ("são paulo", "SP")),
    (("volta redonda", "SP"), ("volta redonda", "RJ")),
]
