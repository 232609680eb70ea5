"""Vocabularies of adverts in French, German, English, Italian, Spanish and Dutch. All are fixed values."""

from __future__ import annotations

# Aliases of makes, in order of precedence.
MAKES = {
    "vw": "Volkswagen", "volkswagen": "Volkswagen", "mercedes": "Mercedes-Benz", "mercedes-benz": "Mercedes-Benz",
    "mercedes benz": "Mercedes-Benz", "mb": "Mercedes-Benz", "bmw": "BMW", "audi": "Audi", "porsche": "Porsche", "mini": "Mini",
    "opel": "Opel", "vauxhall": "Opel", "skoda": "Skoda", "seat": "Seat", "cupra": "Cupra", "peugeot": "Peugeot",
    "renault": "Renault", "dacia": "Dacia", "citroen": "Citroen", "ds": "DS", "ds automobiles": "DS", "alpine": "Alpine",
    "fiat": "Fiat", "abarth": "Abarth", "alfa": "Alfa Romeo", "alfa romeo": "Alfa Romeo", "lancia": "Lancia",
    "maserati": "Maserati", "ferrari": "Ferrari", "lamborghini": "Lamborghini", "toyota": "Toyota", "lexus": "Lexus",
    "honda": "Honda", "nissan": "Nissan", "mazda": "Mazda", "mitsubishi": "Mitsubishi", "subaru": "Subaru", "suzuki": "Suzuki",
    "hyundai": "Hyundai", "kia": "Kia", "ssangyong": "SsangYong", "volvo": "Volvo", "polestar": "Polestar", "saab": "Saab",
    "ford": "Ford", "jaguar": "Jaguar", "land rover": "Land Rover", "landrover": "Land Rover", "range rover": "Land Rover",
    "jeep": "Jeep", "chrysler": "Chrysler", "dodge": "Dodge", "tesla": "Tesla", "byd": "BYD", "mg": "MG", "smart": "Smart",
    "iveco": "Iveco", "man": "MAN",
}

# Model expressions of a make; with a prefix, the label is prefix + group 1, else group 1.
MODELS: dict[str, list[tuple[str, str | None]]] = {
    "BMW": [(r"\b(?:serie\s*|series\s*|)([1-8])(?:er|\s*series|\s*serie)\b", "Serie "), (r"\b([1-8])\d{2}\s*(?:d|i|e|xd|xi|td)\b", "Serie "), (r"\b(x[1-7]|z[34]|i[3-8]|ix[1-3]|ix)\b", None)],
    "Mercedes-Benz": [(r"\b(?:classe|klasse|class)\s*([a-gs])\b", "Classe "), (r"\b([a-gs])\s*[- ]?klasse\b", "Classe "), (r"\b([a-gs])\s?\d{3}\b", "Classe "), (r"\b(gla|glb|glc|gle|gls|cla|cls|slk|slc|sl|amg\s?gt|eqa|eqb|eqc|eqe|eqs|vito|viano|sprinter|citan)\b", None)],
    "Audi": [(r"\b([aqers]\s?\d|tt|rs\s?\d|e-tron|q\d\s?e-tron)\b", None)],
    "Volkswagen": [(r"\b(golf|polo|passat|tiguan|touran|t-roc|t-cross|touareg|arteon|sharan|caddy|transporter|up|id\.?\s?[3-7]|scirocco|beetle|coccinelle)\b", None)],
    "Renault": [(r"\b(clio|megane|captur|kadjar|scenic|espace|twingo|zoe|austral|arkana|talisman|laguna|kangoo|trafic|master|modus)\b", None)],
    "Peugeot": [(r"\b(\d{3,4})\b", None), (r"\b(rifter|partner|expert|boxer|traveller)\b", None)],
    "Citroen": [(r"\b(c\d|c\d\s?aircross|c\d\s?picasso|berlingo|jumpy|jumper|ds\d|spacetourer|ami)\b", None)],
    "Toyota": [(r"\b(yaris|corolla|auris|rav4|c-hr|chr|prius|aygo|proace|hilux|land cruiser|camry|verso)\b", None)],
    "Ford": [(r"\b(fiesta|focus|puma|kuga|mondeo|mustang|ranger|transit|ecosport|s-max|c-max|explorer)\b", None)],
    "Tesla": [(r"\b(model\s?[3sxy])\b", None)],
    "Polestar": [(r"\b(polestar\s?\d|[1-4])\b", None)],
    "Opel": [(r"\b(corsa|astra|insignia|mokka|crossland|grandland|zafira|meriva|adam|combo|vivaro)\b", None)],
}

# Words that are no model.
MODEL_STOPWORDS = ("occasion", "vends", "vend", "vente", "voiture", "auto", "tres", "bon", "etat", "annee", "gebraucht", "used", "car", "km", "cv", "ch", "ps", "kw", "diesel", "essence", "benzin")

# Keywords of each class, in order of precedence.
FUEL = {
    "phev": ("hybride rechargeable", "plug-in", "plug in", "phev", "plugin hybrid", "hybrid rechargeable", "e-hybrid", "recharge", "gte", "gse", "electrique/essence", "electrique / essence", "electrique-essence", "electrique/diesel", "electrique / diesel", "elektro/benzin", "elettrica/benzina", "electrico/gasolina"),
    "electric": ("electrique", "elektro", "elettrica", "electrico", "electric", "bev", " ev ", "e-tron", "id.3", "id.4", "id.5", "zoe", "leaf", "model 3", "model y", "kwh"),
    "hybrid": ("hybride", "hybrid", "mhev", "hev", "e-tech", "e-power", "e-cvt"),
    "ethanol": ("ethanol", "e85", "flexfuel", "flex fuel", "flexifuel", "superethanol", "super ethanol", "bioethanol", "ffv"),
    "lpg": ("gpl", "lpg", "autogas", "bifuel", "bi-fuel"),
    "cng": ("gnv", "cng", "erdgas", "metano", "tgi"),
    "diesel": ("diesel", "gasoil", "gazole", "gasolio", "hdi", "tdi", "dci", "cdi", "bluehdi", "crdi", "jtd", "tdci", "d4d", "bluetec", "cdti", "dtec", "tdv6", "multijet", "skyactiv-d", "bitdi", "blue dci"),
    "petrol": ("essence", "benzin", "benzina", "gasolina", "petrol", "gasoline", "tsi", "tfsi", "vti", "thp", "puretech", "mpi", "gdi", "vvt", "turbo essence", "ecoboost", "firefly", "skyactiv-g", "tce", "sce", "turbo t-gdi"),
}
BADGE_FUEL = (("\\b\\d{3}\\s?e\\b", "phev"), ("\\b\\d{3}\\s?d\\b", "diesel"), ("\\b\\d{3}\\s?i\\b", "petrol"))
GEARBOX = {
    "automatic": ("automatique", "automatik", "automatica", "automatic", "auto.", "boite auto", "bva", "dsg", "edc", "eat6", "eat8", "eat 8", "tiptronic", "s tronic", "s-tronic", "steptronic", "powershift", "cvt", "dct", "multitronic", "g-tronic", "7g-tronic", "9g-tronic", "pdk", "zf8", "e-cvt", "xtronic", "dualogic", "easytronic", "automaat"),
    "manual": ("manuelle", "manuell", "manuale", "manual", "bvm", "boite mecanique", "schaltgetriebe", "handgeschakeld", "mecanique", "6 vitesses", "5 vitesses", "6-gang", "5-gang"),
}
BODY = {
    "cabrio": ("cabriolet", "cabrio", "roadster", "convertible", "decapotable", "spider"),
    "coupe": ("coupe", "fastback"),
    "estate": ("break", "sw", "kombi", "estate", "touring", "avant", "variant", "familiale", "station wagon", "sportbrake", "shooting brake", "t-modell", "t modell", "wagon", "familiare", "sports tourer", "sportstourer", "tourer", "turnier"),
    "suv": ("suv", "4x4", "crossover", "gelandewagen", "tout-terrain", "allrad", "quattro suv", "x-drive suv"),
    "van": ("monospace", "minivan", "mpv", "ludospace", "van", "combi", "utilitaire", "fourgon", "transporter"),
    "pickup": ("pick-up", "pickup", "pick up"),
    "sedan": ("berline", "limousine", "sedan", "saloon", "tricorps"),
    "city": ("citadine", "kleinwagen", "city car", "microcar"),
    "hatch": ("compacte", "hatchback", "5 portes", "3 portes", "fliessheck"),
}
OPTIONS = {
    "toit_ouvrant": ("toit ouvrant", "toit panoramique", "schiebedach", "panoramadach", "sunroof", "panoramic roof", "openable roof", "tetto apribile"),
    "cuir": ("cuir", "leder", "leather", "pelle", "sellerie cuir"),
    "gps": ("gps", "navigation", "navi", "systeme de navigation"),
    "camera_recul": ("camera de recul", "camera 360", "rueckfahrkamera", "reversing camera", "backup camera", "camera arriere"),
    "radar_recul": ("radar de recul", "aide au stationnement", "parking sensors", "pdc", "park assist", "einparkhilfe"),
    "regulateur_adaptatif": ("regulateur adaptatif", "acc", "adaptive cruise", "tempomat adaptiv"),
    "sieges_chauffants": ("sieges chauffants", "sitzheizung", "heated seats", "sedili riscaldati"),
    "carplay": ("carplay", "android auto", "apple car play"),
    "attelage": ("attelage", "crochet", "anhangerkupplung", "tow bar", "towbar", "gancio traino"),
    "led": ("phares led", "full led", "matrix led", "xenon", "bi-xenon", "laserlight"),
    "hayon_electrique": ("hayon electrique", "coffre electrique", "elektrische heckklappe", "power tailgate"),
    "keyless": ("keyless", "sans cle", "smart key", "acces mains libres"),
    "clim_auto": ("clim automatique", "climatisation automatique", "bi-zone", "quadrizone", "klimaautomatik", "dual zone"),
    "jantes_alu": ("jantes alu", "jantes aluminium", "alufelgen", "alloy wheels"),
    "hud": ("affichage tete haute", "head-up", "head up display", "hud"),
    "pack_sport": ("pack sport", "s-line", "s line", "m sport", "m-sport", "amg line", "gt line", "r-line", "r line", "st-line", "st line", "black edition"),
    "siege_electrique": ("sieges electriques", "siege electrique", "elektrische sitze", "electric seats", "memoire de siege"),
    "attelage_elec": ("attelage electrique", "attelage retractable"),
    "suspension_pilotee": ("suspension pilotee", "amortisseurs pilotes", "air suspension", "suspension pneumatique", "luftfederung", "magnetic ride"),
}
PRO_HINTS = ("garage", "concession", "sarl", "sas", "gmbh", "auto", "motors", "automobile", "dealer", "handler", "professionnel", "pro", "s.r.l", "b.v.")
PRIVATE_HINTS = ("particulier", "privat", "private")
# After these words a powertrain keyword names equipment.
EQUIPMENT = ("hayon", "vitres", "vitre", "retroviseurs", "retroviseur", "sieges", "siege", "toit", "frein", "freins", "direction", "pompe", "chauffage", "cable", "prise", "reglage", "ouverture", "fermeture", "coffre", "attelage", "volant", "essuie", "antenne", "trappe", "marchepied")
POWER_BADGES = ("tce", "sce", "tdi", "hdi", "bluehdi", "dci", "tsi", "tfsi", "thp", "puretech", "crdi", "cdti", "tdci", "ecoboost", "multijet", "jtd", "d-4d", "skyactiv-[gd]", "etech", "e-tech")
# Codes on result cards, and seller types of schema.org.
CARD_SELLER = {"d": "pro", "dealer": "pro", "pro": "pro", "p": "private", "private": "private", "priv": "private"}
CARD_FUEL = {"b": "essence", "d": "diesel", "e": "electrique", "c": "gnv", "h": "hydrogene", "l": "gpl", "m": "ethanol", "2": "electrique/essence", "3": "electrique/diesel"}

# Data attributes of a results page's card by field, and selectors of where it writes power and the
# price before.
CARD_FIELDS = {
    "price": ("data-price", "data-price-value", "data-amount"),
    "km": ("data-mileage", "data-km", "data-kilometers"),
    "registration": ("data-first-registration", "data-registration", "data-firstregistration"),
    "postcode": ("data-listing-zip-code", "data-zip-code", "data-zipcode", "data-postcode"),
    "make": ("data-make", "data-brand"),
    "model": ("data-model",),
    "seller": ("data-seller-type", "data-sellertype"),
    "fuel": ("data-fuel-type", "data-fuel"),
    "gearbox": ("data-transmission-type", "data-transmission", "data-gearbox"),
    "power": ("data-power", "data-power-hp"),
}
CARD_POWER = ('[class*="ListItemPill_text"]', '[class*="VehicleDetails"]', ".vehicle-details", ".listing-power")
CARD_BEFORE = ('[class*="PreviousPrice_price"]', "[data-previous-price]", ".previous-price", ".old-price")
# Schema.org types of sellers, and names of fuels in schema.org.
SELLER_KINDS = {"pro": ("autodealer", "organization", "localbusiness", "store", "corporation"), "private": ("person", "individual")}
FUEL_HINTS = {"diesel": "diesel", "gasoline": "essence", "petrol": "essence", "benzin": "essence", "electric": "electrique", "hybrid": "hybride", "lpg": "gpl", "cng": "gnv"}
# Parameters of a URL that only follow clicks, and those that name an advert.
TRACKING = ("ipc", "ipl", "source", "source_otp", "position", "ap_tier", "boost_level", "applied_boost_level", "relevance_adjustment", "boosting_product", "ref", "referrer", "cid", "gclid", "fbclid", "msclkid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "search_id", "sort", "atype")
ID_PARAMS = ("id", "adid", "listingid", "annonceid", "offerid", "vehicleid")

# Signals as code, label, weight, category, usual cost in euros, keywords.
RISKS = (
    ("vendu_en_letat", "Vendu en l'etat, sans garantie", 0.9, "commercial", 0, ("vendu en letat", "en letat", "vendu dans letat", "verkauft wie gesehen", "sold as seen", "as-is", " as is ", "senza garanzia")),
    ("pour_pieces", "Annonce pour pieces ou export", 1.0, "mecanique", 0, ("pour pieces", "pieces detachees", "ersatzteilspender", "bastlerfahrzeug", "for parts", "export uniquement", "nur fur export")),
    ("moteur_hs", "Moteur annonce en panne", 1.0, "mecanique", 4000, ("moteur hs", "moteur a refaire", "moteur casse", "motorschaden", "engine failure", "ne demarre pas", "ne roule pas", "moteur bloque")),
    ("boite_hs", "Boite de vitesses en panne", 0.95, "mecanique", 2500, ("boite hs", "boite a refaire", "getriebeschaden", "gearbox failure", "boite qui craque")),
    ("accidente", "Vehicule accidente ou sinistre", 0.85, "historique", 2000, ("accidente", "vehicule accident", "unfallwagen", "unfallschaden", "sinistre", "vei grave", "vge", "vei", "damaged", "grele", "carrosserie a refaire")),
    ("km_non_garanti", "Kilometrage non garanti", 0.8, "historique", 0, ("km non garanti", "kilometrage non garanti", "compteur non garanti", "kilometerstand nicht garantiert", "mileage not guaranteed", "compteur bloque", "compteur hs")),
    ("ct_ko", "Controle technique absent ou defavorable", 0.7, "administratif", 400, ("sans controle technique", "ct non", "ct a faire", "ct ko", "contre visite", "controle technique a faire", "tuv fallig", "tuv abgelaufen", "mot failed", "revisione scaduta")),
    ("carte_grise_probleme", "Probleme de carte grise / gage", 0.95, "administratif", 0, ("carte grise barree", "sans carte grise", "vehicule gage", "opposition", "kein fahrzeugbrief", "no logbook", "no v5")),
    ("distribution_a_faire", "Distribution a prevoir", 0.5, "entretien", 900, ("distribution a faire", "distribution a prevoir", "courroie a changer", "zahnriemen fallig", "timing belt due", "distribution non faite")),
    ("embrayage_a_faire", "Embrayage fatigue", 0.5, "mecanique", 1200, ("embrayage a faire", "embrayage patine", "embrayage a changer", "kupplung defekt", "clutch slipping")),
    ("turbo", "Turbo defaillant", 0.7, "mecanique", 1500, ("turbo hs", "turbo a changer", "turbolader defekt", "turbo failure")),
    ("injecteurs", "Injecteurs a remplacer", 0.6, "mecanique", 1200, ("injecteurs hs", "injecteur hs", "injecteurs a changer", "injektoren defekt")),
    ("fap_egr", "FAP / EGR en defaut", 0.55, "mecanique", 1300, ("fap hs", "fap a changer", "vanne egr", "egr hs", "dpf defekt", "filtre a particules")),
    ("consomme_huile", "Consommation d'huile anormale", 0.75, "mecanique", 3000, ("consomme de lhuile", "consommation dhuile", "olverbrauch", "burns oil")),
    ("voyant_moteur", "Voyant moteur allume", 0.65, "mecanique", 800, ("voyant moteur", "voyant allume", "motorkontrollleuchte", "check engine", "defaut moteur")),
    ("fumee", "Fumee a l'echappement", 0.7, "mecanique", 0, ("fumee blanche", "fumee bleue", "fume a lechappement", "qualmt")),
    ("joint_culasse", "Suspicion de joint de culasse", 0.95, "mecanique", 2500, ("joint de culasse", "zylinderkopfdichtung", "head gasket")),
    ("rouille", "Corrosion signalee", 0.6, "carrosserie", 800, ("rouille", "corrosion", "rost", "rusty", "point de rouille")),
    ("clim_hs", "Climatisation hors service", 0.3, "confort", 350, ("clim hs", "clim a recharger", "climatisation ne fonctionne pas", "klima defekt")),
    ("ancien_taxi", "Usage intensif (taxi, VTC, auto-ecole, flotte)", 0.6, "historique", 0, ("ancien taxi", "ex taxi", "vtc", "auto ecole", "fahrschule", "taxi", "flotte", "vehicule de societe intensif")),
    ("import", "Vehicule importe", 0.35, "administratif", 500, ("importe", "import allemagne", "import espagne", "vehicule import", "importfahrzeug", "imported", "eu import")),
    ("arnaque", "Signaux typiques d'arnaque a distance", 1.0, "fraude", 0, ("western union", "paiement par mandat", "mandat cash", "je suis a letranger", "transporteur se charge", "paypal uniquement", "vehicule en angleterre", "bon de commande avant visite", "acompte avant visite", "expedition possible")),
    ("urgence", "Vente presentee comme urgente", 0.25, "commercial", 0, ("vente urgente", "urgent", "cause depart", "besoin dargent", "depart etranger", "premier arrive")),
    ("plusieurs_proprios", "Historique multi-proprietaires", 0.3, "historique", 0, ("4eme main", "5eme main", "plusieurs proprietaires")),
)
POSITIVES = (
    ("carnet_entretien", "Carnet d'entretien / factures", 0.8, "entretien", 0, ("carnet dentretien", "carnet entretien", "suivi concession", "scheckheftgepflegt", "scheckheft", "full service history", "factures a lappui", "toutes les factures", "entretien a jour", "historique complet")),
    ("distribution_faite", "Distribution refaite", 0.7, "entretien", 0, ("distribution faite", "distribution refaite", "courroie changee", "zahnriemen neu", "timing belt done", "kit distribution neuf")),
    ("ct_ok", "Controle technique vierge", 0.6, "administratif", 0, ("ct ok", "ct vierge", "controle technique vierge", "ct sans contre visite", "tuv neu", "mot until", "revisione ok")),
    ("premiere_main", "Premiere main", 0.6, "historique", 0, ("premiere main", "1ere main", "1re main", "erstbesitz", "one owner", "unico proprietario")),
    ("garantie", "Garantie proposee", 0.5, "commercial", 0, ("garantie 12 mois", "garantie 6 mois", "garantie constructeur", "garantie mecanique", "mit garantie", "warranty")),
    ("non_fumeur", "Vehicule non fumeur", 0.2, "etat", 0, ("non fumeur", "nichtraucher", "non smoker")),
    ("pneus_neufs", "Pneus recents", 0.3, "entretien", 0, ("pneus neufs", "pneus recents", "neue reifen", "new tyres", "4 pneus neufs")),
    ("freins_neufs", "Freinage refait", 0.3, "entretien", 0, ("freins neufs", "plaquettes neuves", "disques neufs", "bremsen neu")),
    ("embrayage_neuf", "Embrayage neuf", 0.4, "entretien", 0, ("embrayage neuf", "embrayage change", "kupplung neu")),
    ("revision_faite", "Revision recente", 0.4, "entretien", 0, ("revision faite", "vidange faite", "revision recente", "grosse revision", "inspektion neu")),
)
NEGATIONS = ("pas de", "pas d", "aucun", "aucune", "sans", "jamais", "non", "ni", "never", "no", "kein", "keine", "nicht", "nie", "mai", "nunca")

# Known weaknesses as code, title, what to verify, cost, severity, makes, fuels, years, keywords, most km a year.
DEFECTS = (
    ("psa_puretech_courroie_humide", "PureTech 1.2 - courroie de distribution immergee", "Courroie remplacee (facture) ou moteur post-2022, niveau et proprete de l'huile, bruit a froid.", 1500, 5, ("Peugeot", "Citroen", "DS", "Opel"), (), (2013, 2022), ("puretech", "1.2 puretech", "eb2dts", "130 puretech", "110 puretech"), None),
    ("bmw_n47_chaine", "Diesel N47 - chaine de distribution cote volant moteur", "Bruit de chaine au demarrage a froid, facture de remplacement, historique constructeur.", 2500, 5, ("BMW",), (), (2007, 2011), ("n47", "116d", "118d", "120d", "316d", "318d", "320d", "520d", "x1 18d", "x3 18d"), None),
    ("vw_dsg_dq200", "DSG 7 a sec (DQ200) - mecatronique", "Passage des rapports a froid en manoeuvre, vidange boite effectuee, mecatronique remplacee.", 2000, 4, ("Volkswagen", "Audi", "Seat", "Skoda", "Cupra"), (), (2008, 2016), ("dsg 7", "dq200", "dsg7", "s tronic 7"), None),
    ("renault_tce_12_huile", "1.2 TCe - consommation d'huile et turbo", "Niveau d'huile, fumee bleue, factures de vidange rapprochees, remplacement moteur eventuel.", 3500, 5, ("Renault", "Nissan", "Dacia"), (), (2012, 2016), ("1.2 tce", "tce 115", "tce 120", "h5ft"), None),
    ("ford_ecoboost_courroie", "1.0 EcoBoost - courroie humide et circuit de refroidissement", "Courroie et pompe a eau remplacees, traces de surchauffe, niveau de liquide.", 1400, 4, ("Ford",), (), (2012, 2019), ("1.0 ecoboost", "ecoboost 125", "ecoboost 100"), None),
    ("audi_ea888_huile", "2.0 TFSI (EA888 gen2) - segmentation et tendeur de chaine", "Consommation d'huile au litre/1000 km, tendeur mis a jour, compressions.", 3000, 4, ("Audi", "Volkswagen", "Seat", "Skoda"), (), (2008, 2012), ("2.0 tfsi", "ea888", "tfsi 211", "tfsi 200"), None),
    ("mercedes_om651_injecteurs", "OM651 - injecteurs et chaine sur les premieres series", "Factures d'injecteurs, bruit a froid, retours de fuite.", 1800, 3, ("Mercedes-Benz",), (), (2009, 2014), ("om651", "220 cdi", "200 cdi", "220 d", "250 cdi"), None),
    ("cvt_xtronic", "Boite CVT X-Tronic - usure prematuree", "Vidange de boite respectee, comportement a chaud, historique.", 3500, 4, ("Nissan", "Renault", "Mitsubishi"), (), (2010, 2020), ("xtronic", "cvt", "x-tronic"), None),
    ("fap_trajets_courts", "Diesel a usage urbain - FAP et vanne EGR encrasses", "Kilometrage annuel coherent avec un usage route, historique de regeneration, etat du FAP.", 1300, 3, (), ("diesel",), (2009, 2030), (), 12000),
    ("adblue_scr", "Systeme AdBlue / SCR - pannes de pompe et de capteur", "Absence de message AdBlue, historique de remplacement de la pompe.", 1200, 3, (), ("diesel",), (2015, 2030), ("adblue", "scr", "euro 6", "bluehdi", "blue dci", "bluetec"), None),
    ("zoe_batterie_location", "Renault Zoe - batterie parfois en location", "Batterie achetee ou louee, montant du loyer, transfert du contrat.", 0, 3, ("Renault",), (), (2012, 2022), ("zoe",), None),
    ("ev_sante_batterie", "Vehicule electrique - etat de sante de la batterie", "Certificat SoH (state of health), historique de charge rapide, garantie batterie restante.", 0, 4, (), ("electric", "phev"), (2011, 2030), (), None),
    ("dpf_mazda_skyactiv", "Skyactiv-D 2.2 - dilution d'huile et FAP", "Niveau d'huile, usage majoritairement autoroute, mises a jour constructeur.", 2000, 4, ("Mazda",), (), (2012, 2019), ("skyactiv-d", "2.2 skyactiv", "150 skyactiv"), None),
    ("tesla_m3_suspension", "Model 3 premieres series - trains roulants et finitions", "Bruits sur route degradee, historique d'interventions, version du MCU.", 900, 2, ("Tesla",), (), (2017, 2021), ("model 3", "model y"), None),
    ("bva_zf8_vidange", "Boite ZF 8 rapports - vidange trop souvent oubliee", "Vidange de boite faite vers 80-100 000 km, facture a l'appui.", 600, 2, ("BMW", "Audi", "Jaguar", "Land Rover", "Volkswagen"), (), (2010, 2030), ("zf8", "steptronic", "tiptronic 8", "bva8"), None),
)
