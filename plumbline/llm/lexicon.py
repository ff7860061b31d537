"""Fixed words and grammars in English, German, French and Spanish."""

from __future__ import annotations

import re

#: Common words that mark a language, among them those of short answers and menus (fixed values).
MARKERS = {
    "en": "the and of to is are was it that this with for on you your not have has can how what who where why when which do does did will from there here any more been were would should but they we my an be or if as at by yes sure open choose press settings billing members projects runs advanced history sharing limits confirm apply continue save changes entry nobody about".split(),
    "de": "der die das und ist nicht ein eine einen einem den dem des mit für auf sie du ich wir ihr es zu wie was wer wo warum kann kannst wenn dann von im noch nur auch oder aber bei nach seit bis mehr muss wird werden sich als aus sind hat haben diese dieser öffne wähle drücke einstellungen abrechnung mitglieder projekte läufe erweitert verlauf grenzen bestätigen übernehmen weiter eintrag ja nein bitte danke schau hilfe unter".split(),
    "fr": "le la les et est pas un une des du de dans pour avec sur tu vous je nous il elle ce cette que qui où pourquoi comment peut peux si puis plus ne au aux son sa ses mon ton votre notre être été sont depuis mais ou par sans rien choisis ouvre appuie réglages facturation membres projets tests avancé historique limites confirmer appliquer continuer ligne oui non merci regarde aide cela".split(),
    "es": "el la los las y es no un una unos del de en para con por que quién dónde cómo qué cuándo puede puedo puedes si más se su sus mi tu este esta esto desde pero o sin ya lo al como está son hay abre elige pulsa ajustes facturación miembros proyectos pruebas avanzado historial límites confirmar aplicar primera línea engranaje sí gracias mira ayuda cada todo".split(),
}
LANGUAGE_OF: dict[str, tuple[str, ...]] = {}
for _lang, _list in MARKERS.items():
    for _w in _list:
        LANGUAGE_OF[_w] = (*LANGUAGE_OF.get(_w, ()), _lang)

#: The prompt asks for an answer in another language.
ASKS_LANGUAGE = re.compile(
    r"\b(?:in|into|to|auf|ins|en|al|a[un]?|answer|reply|respond)\s+(?:plain |simple |einfachem |)?(?:english|german|french|spanish|italian|english|englisch(?:e[nm]?)?|deutsch(?:e[nm]?)?|französisch(?:e[nm]?)?|spanisch(?:e[nm]?)?|anglais|allemand|français|espagnol|inglés|alemán|francés|español)\b|\btranslat|\bübersetz|\btradui|\btraduc", re.I)

#: Answers that only fill the place of one.
FILLER = re.compile(r"^(?:n/?a|none|null|nil|nan|undefined|todo|tbd|tba|empty|blank|no (?:answer|response|reply|content)|placeholder|lorem ipsum|keine antwort|leer|sans réponse|vide|sin respuesta|vacío|kein inhalt|ohne antwort|aucune réponse|missing|pending|error|(?:\s|[^\w])*)$", re.I)

_I = r"(?:i|we)"
_NO = r"(?:can(?:no|')?t|cannot|can not|am not able to|'m not able to|are not able to|am unable to|'m unable to|are unable to|won'?t|will not|would rather not|'d rather not|do not|don'?t|am not allowed to|'m not allowed to|are not allowed to|must not|may not|am not going to|'m not going to|prefer not to|am not permitted to)"
_DO = r"(?:help|assist|answer|reply|respond|comment|give|provide|discuss|talk|take part|walk|go into|do (?:that|this)|support|continue|share|offer|engage|explain|fulfil|comply|say|advise)"
_R = [
    # English
    rf"\b{_I} ?{_NO} (?:\w+ )?{_DO}\b", r"\bi (?:have|need|must|will have) (?:to )?(?:decline|refuse|pass)\b", r"\bi (?:refuse|decline)\b", r"\bi must pass\b",
    r"\bmy (?:guidelines|rules|policy|policies|instructions) (?:do not|don'?t|forbid|prevent|prohibit|won'?t)\b", r"\bgoes? against (?:my|our) (?:rules|guidelines|policy|policies)\b", r"\bviolates (?:my|our)\b",
    r"^(?:not going to|won'?t|cannot|can'?t) (?:answer|help|do|discuss)\b", r"^no can do\b", r"^request (?:declined|denied|refused)\b", r"\bfor (?:legal|policy|privacy|safety|security) reasons\b.*\b(?:cannot|can'?t|do not|don'?t|won'?t|must)\b",
    rf"\b(?:is not|isn't|are not|aren't|was not|not) (?:\w+ )?(?:appropriate|suitable|proper|acceptable|something|anything|a (?:question|topic|matter|subject))\b.*\b(?:i|we|me|us)\b", r"\bno (?:answer|reply|response|help|comment) (?:can|could|may|will|shall) be (?:given|offered|provided|made)\b", r"\bno (?:answer|reply|help) is possible\b", r"\b(?:would|does|will|may) go against (?:my|our)\b",
    # German
    r"\b(?:keine|keinerlei) (?:antwort|auskunft|hilfe) (?:geben|möglich|gegeben|erteilt)\b|\bkann (?:hier )?keine (?:antwort|auskunft) (?:gegeben|erteilt) werden\b|\b(?:ist|sind) (?:nichts|nicht(?:s)? (?:angebracht|angemessen|passend))\b.*\b(?:ich|mich|mir|wir|uns)\b",
    r"\b(?:kann|darf|möchte|werde|will) (?:ich|wir)\b.*\b(?:nicht|keine?)\b.*\b(?:helfen|beantworten|eingehen|äußern|sprechen|antworten|geben|unterstützen|weiterhelfen|beteiligen|sagen)\b", r"\b(?:ich|wir) (?:kann|können|darf|dürfen|möchte|möchten|werde|werden|will)\b.*\b(?:nicht|keine?)\b.*\b(?:helfen|beantworten|eingehen|äußern|sprechen|antworten|geben|unterstützen|weiterhelfen|beteiligen|sagen)\b",
    r"\bmuss (?:ich )?(?:das|dies|es)? ?(?:leider )?ablehnen\b|\bmuss das ablehnen\b|\blehne (?:ich )?(?:das|dies)? ?ab\b", r"\bnicht erlaubt\b", r"\bverstößt gegen (?:meine|unsere)\b", r"\bals (?:\w+ )?(?:assistent|sprachmodell|hilfe|ki)\b.*\b(?:nicht|keine?)\b", r"^anfrage abgelehnt\b",
    # French
    r"\baucune (?:réponse|aide) ne (?:peut|sera)\b|\bn'est pas (?:approprié|convenable|quelque chose)\b.*\b(?:je|moi|nous)\b|\bn'est pas (?:quelque chose|une question) (?:que|à laquelle|dont) (?:je|nous)\b",
    r"\bje ne (?:peux|puis|suis|donne|réponds|souhaite|veux|commente)\b.*\b(?:pas|aucun)\b.*", r"\bje (?:dois|préfère) (?:refuser|décliner|ne pas|passer)\b", r"\bje refuse\b", r"\b(?:interdit|pas autorisé|pas le droit) (?:d'|de |à )", r"\bva contre (?:mes|nos)\b|\bva à l'encontre\b", r"\bje n'ai pas le droit\b", r"^demande refusée\b",
    # Spanish
    r"\bno (?:se )?(?:puede|es posible) dar(?:se)? (?:una|ninguna|aquí ninguna) (?:respuesta|ayuda)\b|\bno es (?:apropiado|adecuado|conveniente)\b.*\b(?:yo|mí|me|nosotros)\b|\bno es (?:algo|una pregunta) (?:que|a la que)\b.*\b(?:pueda|puedo|podamos)\b",
    r"\bno (?:puedo|podemos|estoy autorizad[oa]|me está permitido|doy|respondo|quiero|debo|comento)\b", r"\bprefiero no\b", r"\b(?:tengo que|debo) (?:rechazar|negarme)\b", r"\bme niego\b", r"\bva contra (?:mis|nuestras)\b", r"^(?:petición|solicitud) rechazada\b", r"\bno me es posible (?:ayudar|responder)",
]
#: A sentence that declines.
DECLINES = re.compile("|".join(_R), re.I)
#: Sentences that may stand around a refusal without being help.
COURTESY = re.compile(
    r"^(?:(?:i'?m |we'?re |so )?sorry|my apologies|i apologi[sz]e|apologies|unfortunately|thanks?|thank you|i understand|i hope you understand|please understand|is there anything|can i help|let me know if|let'?s talk|please choose|still|hello|hi|dear|good (?:morning|day)|your (?:question|request|message)|we (?:have )?(?:received|got)|you ask|that is a|this (?:question|topic)|for (?:legal|policy|privacy|safety)|as an? |"
    r"leider|entschuldigung|tut mir leid|danke|vielen dank|bitte|kann ich sonst|ich verstehe|hallo|guten tag|deine (?:frage|anfrage)|ihre (?:frage|anfrage)|die (?:frage|anfrage)|wir haben|trotzdem|als |"
    r"désolé|je regrette|malheureusement|merci|puis-je|je comprends|bonjour|salut|ta (?:question|demande)|votre|excuse|pardon|en tant que|"
    r"lo siento|lamento|lamentablemente|por desgracia|gracias|perdona|disculpa|entiendo|espero|puedo ayudar|¿puedo|hola|tu (?:pregunta|petición)|hemos recibido|como )", re.I)

#: Determiners: a noun must follow (fixed values).
DETERMINERS = frozenset(
    "a an the my your our their every der das den dem des ein eine einen einem einer eines kein keine keinen mein meine dein deine seine ihren unser unsere euer eure diesen dieses "
    "le la les un une des du au aux mon ma mes ton ta tes sa ses notre nos votre vos leur leurs ce cet cette ces chaque el los las una unos unas del al mi mis tu tus su sus nuestro nuestra vuestro vuestra cada".split()
)
#: Other words after which a phrase is not complete: prepositions, conjunctions, auxiliaries, clitics (fixed values).
WAITING = DETERMINERS | frozenset(
    "his her its this these those each no some any another other of to in on at by for from with without within into onto about after before under over per than as until during between through against among toward and or but nor if because although though while when where whether that which who whose unless since so is are was were be been being am has have had does do did can could will would shall should may might must not isn't aren't don't doesn't can't cannot very too more most less rather only also else even just "
    "die sein ihr ihre dieser jede jeder jedes jedem von zu zum zur im in ins am an auf aus bei beim mit nach seit über unter vor für durch gegen ohne um zwischen innerhalb bis und oder aber denn sondern wenn falls weil dass ob als wie sobald obwohl ist sind war waren hat haben sehr nur auch noch etwa nicht mehr "
    "de son à dans en sur sous par pour avec sans chez vers depuis pendant après avant contre entre et ou mais donc car si que qui quand lorsque comme dont est sont était sera a ont avait peut doit ne se y plus très trop environ aussi "
    "lo esta este estos estas con por sin sobre desde hasta hacia para ante bajo tras durante según o pero sino porque cuando donde cual quien es están está era fue ha han puede debe no muy más menos también".split()
)
#: English words that end a phrase where they belong to a verb (fixed values).
PARTICLES = frozenset("in on off up out over".split())
#: Words that open a subordinate clause; at the beginning of a sentence the main clause must follow behind a comma (fixed values).
LEADING = frozenset("if when while because although though unless since once until wenn falls weil obwohl sobald solange während nachdem si quand lorsque puisque cuando aunque mientras porque".split())
#: German verbs that wait for an infinitive or a participle at the end of their clause (fixed values).
MODALS = frozenset("kannst können könnt kann müssen musst müsst darfst dürfen dürft sollst sollen sollt möchten möchte".split())
PASSIVES = frozenset("wird werden wurde wurden".split())
