"""Ideas that messages of servers and templates are made of, in many languages. Fixed values, in lower case; * stands for any letters."""

from __future__ import annotations

_W: dict[str, list[str]] = {
    # scripts, cookies, browsers
    "script": [
        "przeglądarc*/webbläsaren/webbläsarens/navigatorul/tarayıcınız*/javascript'i/javascriptu/javascriptul/прагляд*/браузър*/selaimesi/prohlížeč*",
        "javascript/java script/js/script/scripts/scripting/browser scripts/cookie/cookies/browser/browsers/web browser/noscript/ad blocker/adblock*",
        "skript*/navigateur*/navegador*/webbrowser*/przeglądark*/skrypt*/ciasteczk*/webläsare*/tarayıcı*/çerez*/selain*/prohlížeč*/böngésző*/trình duyệt/kịch bản",
        "скрипт*/куки/браузер*/джаваскрипт/сценари*/περιηγητ*/πρόγραμμα περιήγησης/σενάρι*/ջավասկրիպտ/դիտարկիչ*/זפזפן/דפדפן*/סקריפט*/עוגיות",
        "متصفح*/المتصفح*/جافاسكريبت/جافا سكريبت/سكريبت/السكريبت/ملفات تعريف الارتباط/بملفات تعريف الارتباط/الكوكيز/مرورگر*/ब्राउज़र/ब्राउज़र/जावास्क्रिप्ट/कुकी*/कुकीज़/স্ক্রিপ্ট/জাভাস্ক্রিপ্ট/ጃቫስክሪፕት/ጃቫስክሪፕትን/አሳሽ*/ኩኪ*",
        "クッキー/ブラウザ/ブラウザー/スクリプト/ジャバスクリプト/浏览器/瀏覽器/脚本/腳本/指令碼/브라우저/자바스크립트/쿠키/스크립트/เบราว์เซอร์/จาวาสคริปต์/คุกกี้/สคริปต์",
    ],
    # what tells a story or speaks about messages
    "story": [
        "gone to/having gone/said/says/told/asked/replied/answered/explains/explained/recounts/lecture/essay/novel/described/describes/she/he/his/her/sagte/erzählt*/erklärt*/fragte/antwortete/dit-elle/dit-il/disait/raconte*/explique*/demanda/dijo/preguntó/explica*/contó/disse/chiese/racconta*/spiega*/zei/vroeg/vertelt/powiedzia*/zapyta*/sade/frågade/сказал*/спросил*/рассказ*/объясн*/είπε/ρώτησε/εξηγεί/dedi/sordu/anlat*/ասաց/հարցրեց/قال/قالت/سأل/حكى/कहा/पूछा/बताया",
        "と言った/と尋ねた/说道/问道/他说/她说/말했다/물었다",
    ],
    # being enabled, required or supported
    "need": [
        "switch/turn/activez/activa/active/activar",
        "enable/enabled/enabling/activate/activated/turn on/turned on/turn them on/turn it on/turn off/turned off/switch on/switched on/switch it on/switch them on/switched off/allow/allowed/require/required/requires/need/needs/needed/must/necessary/disabled/off/block/blocks/blocking/supported/supports/support/unsupported/outdated/upgrade/update/accept/checking/depends on/rely on/relies on/works only with/without",
        "aktivier*/deaktivier*/einschalten/eingeschaltet/ausgeschaltet/erlauben/erlauben sie/zulassen/zugelassen/erforderlich/benötig*/braucht/unterstütz*/muss/müssen/notwendig/schalten sie/ein/ohne",
        "activ*/activé*/désactiv*/autoris*/requis*/nécessaire*/nécessit*/permett*/accept*/doit/doivent/pris en charge/prend en charge/sans/habilit*/permit*/requier*/necesit*/necesari*/desactivad*/sin/encend*/admite",
        "ative/ativar/ativad*/ativo/exige/precisa/requer/suporta/desativad*/sem/necessári*/permita/abilit*/attiva*/disattivat*/consenti*/richied*/richiest*/necessari*/supporta*/senza",
        "schakel/inschakelen/ingeschakeld/uitgeschakeld/toestaan/sta/toe/vereist/nodig/ondersteunt/zonder/włącz*/wyłącz*/wymag*/zezwól/obsług*/potrzebn*/bez/aktivera*/aktiverat/slå på/slå/på/tillåt*/krävs/kräver/stöd*/utan",
        "включ*/отключ*/выключ*/разреш*/активир*/требу*/необходим*/нужн*/нужен/поддержив*/без/увімкн*/вимкн*/потріб*/ενεργοποι*/απενεργοποι*/απαιτ*/επιτρ*/χρειάζ*/υποστηρ*/χωρίς",
        "etkinleştir*/etkin/açın/gerekli*/gerektir*/izin/devre dışı/destekle*/միացն*/միացր*/անջատ*/պահանջ*/անհրաժեշտ/הפעל*/נדרש*/אפשר*/bật/yêu cầu/hỗ trợ",
        "تفعيل*/تمكين*/السماح/مطلوب*/يتطلب/تتطلب/يحتاج/تحتاج/معطل*/تشغيل*/فعل/يدعم/تدعم/ضروري/يلزم/बिना/सक्षम/चालू/सक्रिय/आवश्यक*/ज़रूरी/जरूरी/अनुमति/अक्षम/बंद/समर्थन/ያንቁ/አንቃ/ያብሩ/ያስፈልጋል/ይፍቀዱ",
        "有効/無効/オン/オフ/許可/必要/対応/サポート/启用/啟用/开启/開啟/打开/打開/允许/允許/需要/必须/必須/支持/支援/禁用/关闭/關閉/활성화/사용/허용/필요/켜/지원/비활성화/เปิดใช้งาน/เปิด/ต้อง/อนุญาต/รองรับ",
    ],
    "human": [
        "confirm/prove/confirm you/prove you/complete the captcha/bestätigen/beweisen/vérifiez/confirmez/prouvez/demuestra/demuestre/confirme/confirma/verifique/dimostra/conferma/verifica/prove que/comprove/bevestig/bewijs/potwierdź/udowodnij/bekräfta/visa att/подтвердите/докажите/επιβεβαιώστε/αποδείξτε/doğrulayın/kanıtlayın/հաստատեք/أكد/تأكد/أثبت/पुष्टि/साबित/確認/証明/证明/證明/确认/확인/증명/que no eres/dass sie/que vous n'êtes/روبوتا",
        "action below",
        "captcha/recaptcha/robot/robots/bot/bots/human/not a robot/are you human/verify/verify you/verification/automated/unusual traffic/security check/mensch*/roboter*/humain*/humano*/umano/automatizad*/automatisiert*",
        "робот*/человек*/проверк*/ρομπότ/άνθρωπος/روبوت*/إنسان*/बॉट/रोबोट/इंसान/मनुष्य/सत्यापित/ロボット/人間/認証/机器人/機器人/验证/驗證/人类/로봇/인증/หุ่นยนต์",
    ],
    # something failed
    "failure": [
        "prevented/attempts/durante/uppstod/verhindert*/aufgetreten/produite/overloaded/busy/congested/überlastet*/surchargé*/sobrecargad*/sovraccaric*/sobrecarregad*/overbelast*/przeciążon*/överbelasta*/перегружен*/занят*/απασχολημέν*/υπερφορτωμέν*/meşgul/yoğun/մանրաբեռնված/مشغول/व्यस्त/混み合って/混雑/繁忙/拥挤/혼잡/reset/limited",
        "temporary/encountered/serverfel/serverfehler/serverfejl/ungültig/invalide/inválid*/non valid*/ongeldig/nieprawidłow*/ogiltig*/недействител*/μη έγκυρ*/geçersiz*/غير صالح/अमान्य/無効です/失效/无效/無效/유효하지/under repair/repair/security reasons/sicherheitsgründen/raisons/sécurité/motivos/seguridad/motivi/sicurezza/razões/segurança/veiligheidsredenen/bezpieczeństwa/säkerhetsskäl/безопасности/соображений/λόγους/ασφαλείας/güvenlik/أمنية/लिए सुरक्षा/安全上の理由/安全原因/보안상",
        "broken/broke/something/problems/defekt*/kaputt/rompu/cassé*/roto/rota/rotto/quebrad*/interrotto/kapot/uszkodzon*/trasig*/битая/сломан*/σπασμέν*/bozuk/quelque chose/quelque/algo/qualcosa/iets/coś/något/etwas/что-то/что то/щось/κάτι/bir şey/bir şeyler/ինչ-որ/شيء/ما خطأ/कुछ/何か/何らかの/某些/出了点/뭔가/errado/mal/storto",
        "trouble/unerwartet*/inattendu*/inesperad*/inattes*/imprevist*/onverwacht*/nieoczekiwan*/ovänt*/beklenmedik/непредвиденн*/неожиданн*/απροσδόκητ*/अप्रत्याशित/متوقع/անսպասելի/予期しない/予期せぬ/意外/예기치",
        "interrupted/unknown error/temporarily/not working/stopped working/unterbrochen/vorübergehend/zeitweise/interrompu*/momentané*/temporairement/interrumpid*/temporalmente/momentáneamente/interrott*/temporaneamente/momentaneamente/interrompid*/temporariamente/onderbroken/tijdelijk/przerwan*/tymczasowo/chwilowo/avbruten/tillfälligt/прерван*/временно/тимчасово/διακόπηκε/προσωρινά/kesildi/geçici*/ժամանակավոր*/مؤقتا/مؤقتًا/انقطع/अस्थायी/बाधित/一時的/暂时/暫時/일시적",
        "error/errors/failed/fail/failure/fails/exception/fatal/traceback/most recent call last/crash/crashed/oops/whoops/uh oh/went wrong/gone wrong/timed out/time out/timeout/has expired/expired/invalid/unexpected/bad gateway/bad request/too many/too many requests/overloaded/technical/technical difficulties/internal/undefined/rate limit*/try again/outage/refused/broken/http error/unable to/problem",
        "fehler*/abgelaufen/ungültig*/fehlgeschlagen/schiefgelaufen/schief gelaufen/störung*/erreur*/expiré*/échou*/échec/problème*/mal passé/mal tourné/falló/fallo/caducad*/ha caducado/expirad*/problema*/salió mal/ha ido mal",
        "errore*/scadut*/andato storto/non riuscit*/erro/erros/expirou/falha*/falhou/deu errado/fout/foutmelding/verlopen/mislukt/mis gegaan/misgegaan/storing/błąd*/błęd*/wygas*/niepowodzeni*/nie tak/awari*/fel/felmeddelande/misslyckad*/gick fel/löpt ut/chyba/virhe*/hiba*/lỗi",
        "ошибк*/истек*/истекла/сбой/сбоя/сбои/не удалось/неполадк*/неверн*/не так/помилк*/σφάλμα*/έληξε/απέτυχε/πρόβλημα*/στραβά/hata*/süresi doldu/sona erdi/başarısız*/yanlış/սխալ*/ձախող*/שגיאה*/תקלה",
        "خطأ/خطا/انتهت/انتهت صلاحية/فشل/مشكلة/عطل/त्रुटि*/समाप्त/विफल/गलत/गड़बड़*/समस्या/ত্রুটি/ስህተት*/አልተሳካም",
        "エラー/失敗/期限切れ/切れました/問題/障害/タイムアウト/不具合/错误/錯誤/失败/失敗/过期/過期/超时/逾時/出错/异常/過多/过多/故障/오류/에러/실패/만료/문제/ข้อผิดพลาด/ผิดพลาด/หมดอายุ/ล้มเหลว",
    ],
    # something is refused
    "refusal": [
        "disabled/limited/restricted/eingeschränkt*/limité*/limitad*/limitat*/beperkt/ograniczon*/begränsa*/ограничен*/περιορισμέν*/kısıtlan*/محدود*/تعليق/सीमित/制限され/受限/stängts av/ανασταλεί/zablokowan*",
        "not authorized/not authorised/authorized/authorised/nicht berechtigt/autorizad*/autorizzat*/gerechtigd",
        "toegang tot/geen toegang/izniniz/izin yok/violating/violation/terms/policy/nutzungsbedingungen/conditions/términos/termini/termos/voorwaarden/regulamin*/villkor/правил*/όρους/koşullar*/شروط/नियमों/規約/条款/약관",
        "permisos/permiso/permissão/permesso/permessi/berechtigung*/autorisation/droits/uprawnie*/behörighet/прав/разрешени*/toestemming/δικαίωμα/άδεια/إذن/صلاحية/अनुमति/权限/權限/권한/権限/δεν επιτρέπεται/nicht gestattet/nicht erlaubt/no permitid*/não permitid*/non consentit*/niet toegestaan/не разрешен*/không được phép",
        "denied/forbidden/blocked/suspended/banned/unauthorized/unauthorised/restricted/permission/not allowed/not permitted/prohibited/rejected/deactivated/terminated",
        "verweigert/gesperrt*/verboten/blockiert*/keine berechtigung/refusé*/interdit*/bloqué*/suspendu*/denegad*/prohibid*/bloquead*/suspendid*/negat*/vietat*/bloccat*/sospes*/negado*/proibid*/suspenso/suspensa/suspensos",
        "geweigerd/verboden/geblokkeerd/opgeschort/odmow*/odmówion*/zabronion*/zablokowan*/zawieszon*/nekad*/blockerad*/förbjud*/avstäng*/spärrad*",
        "запрещ*/заблокирован*/приостановлен*/ограничен*/отказано/заборонен*/απαγορ*/αποκλει*/αναστ*/απορρίφθηκε/engellen*/reddedildi/yasak*/askıya/մերժ*/արգել*/נדחתה/חסומ*/אסור*",
        "مرفوض*/رفض/محظور*/حظر*/ممنوع*/معلق/موقوف*/مرفوضة/अस्वीकृत/अस्वीकार/वर्जित/अवरुद्ध/निलंबित/प्रतिबंधित/ተከልክሏል/ታግዷል",
        "拒否/禁止/ブロック/停止/制限/拒绝/拒絕/封禁/停用/限制/阻止/屏蔽/封锁/거부/차단/금지/정지/제한/ปฏิเสธ/ห้าม/บล็อก/ระงับ",
    ],
    # something is not there
    "absence": [
        "taken down/moved/moved permanently/has been moved/verschoben/déplacé*/movid*/trasladad*/spostat*/verplaatst/przeniesion*/flyttat*/перемещ*/перенес*/μεταφέρθηκε/taşındı/տեղափոխ*/تم نقل/نقل/स्थानांतरित/移動しました/已移动/已移動/이동되/не знайдено/no se encontró/nie został znaleziony/matched/no match",
        "gelöscht/wurde gelöscht/wurde entfernt/a été supprimé/fue eliminad*/è stat* rimoss*/foi removid*/is verwijderd/tagits bort/borttagen/удалено/удалён/было удалено/διαγράφηκε/silindi/kaldırılmış/ջնջվ*/تم حذف/حذف/हटा दी/हटा दिया/削除されました/已被删除/删除/刪除/삭제되",
        "no longer available/nicht länger/plus disponible/n'est plus/no está disponible/non è più/já não/não está/niet meer/nie jest już/inte längre/больше не/πλέον διαθέσιμ*/artık/այլևս/لم يعد/अब उपलब्ध/ご利用いただけません/利用いただけません/已不可用/不再/더 이상",
        "not found/not be found/unavailable/no longer/does not exist/doesn't exist/nothing was found/no results/nothing found/missing/gone/removed/deleted/has moved/been moved/dead link/cannot be found/can't be found/couldn't be found/not available/temporarily unavailable/nowhere to be found",
        "nicht gefunden/nicht mehr/nicht verfügbar/existiert nicht/gelöscht/entfernt/nicht erreichbar/introuvable*/indisponible*/inaccessible*/n'existe/n'existe plus/non trouvé*/supprimé*/no encontrad*/no existe/ya no/eliminad*/no disponible/non trovat*/non esiste/rimoss*/non disponibile/não encontrad*/não existe/indisponív*/removid*",
        "niet gevonden/bestaat niet/niet beschikbaar/verwijderd/nie znalezion*/nie istnieje/niedostępn*/usunięt*/hittades inte/finns inte/kunde inte hittas/inte tillgänglig/bulunamadı/mevcut değil/kaldırıldı/không tìm thấy/không tồn tại",
        "не найден*/не существует/недоступ*/удален*/удалён*/больше нет/не знайден*/δεν βρέθηκε/δεν υπάρχει/μη διαθέσιμ*/δεν είναι διαθέσιμ*/չի գտնվել/չկա/հասանելի չէ/לא נמצא*/אינו קיים",
        "غير موجود*/لم يتم العثور/غير متاح*/غير متوفر*/لا يوجد/لا توجد/محذوف*/नहीं मिला/नहीं मिली/नहीं मिल*/उपलब्ध नहीं/मौजूद नहीं/हटा*/পাওয়া যায়নি/አልተገኘም/የለም",
        "見つかりません/見つかりませんでした/存在しません/ありません/見当たりません/利用できません/削除/不存在/找不到/未找到/没有找到/沒有找到/无法访问/不可用/已删除/찾을 수 없습니다/존재하지 않/없습니다/사용할 수 없/삭제/ไม่พบ/ไม่มี",
    ],
    "negation": [
        "չունի/չունեք/չեք/չեն/konnten/couldn't/we could not/were unable",
        "kann/konnten/können nicht/n'a pas/no se/no pudimos/non è/não foi/não foi possível/kon niet/nie można/nie udało/kunde inte/не мы/не нашли/не нашлась/не удаётся/δεν μπορεί/δεν μπορούμε/olmadı/mümkün/չհաջողվեց/لا يمكن/لم نتمكن/नहीं हो",
        "not/no/cannot/can't/couldn't/could not/doesn't/does not/don't/do not/didn't/isn't/wasn't/won't/unable/nothing/without/never/nicht/kein/keine/keinen/leider/pas/aucun/aucune/plus/ne/n'/ningún/ninguna/nessun*/impossibile/impossible/imposible/não/nenhum*/non/niet/geen/nie/brak/inte/ingen/inget/kan inte/değil/yok/không",
        "не/нет/невозможно/нельзя/немає/δεν/δε/μη/αδυναμία/αδύνατη/չ/չի/չկա/չէ/לא/אין/لا/لم/ليس/ليست/غير/تعذر/يتعذر/لن/नहीं/অক্ষম/ません/ない/なく/できませ/不/没有/沒有/无法/無法/未/不能/없/않/못/ไม่",
    ],
    "finding": [
        "functioning/work/works/working/functionality/funktionier*/funktionsfähig/fonctionn*/funcion*/funzion*/werken/werkt/działa*/fungera*/работа*/λειτουργ*/çalış*/काम करता/काम करती/يعمل/作動/動作/运行/運行/작동/opened/responded/geöffnet/ouvert/ouvrir/abrir/aberto/aperto/aprire/geopend/otworzyć/öppnas/открыт*/ανοίξει/açıl*/بفتح/खुल*/開け/开启失败/열 수",
        "antwortet/antworten/reagiert/répond*/responde*/respondiendo/risponde*/antwoordt/reageert/odpowiada/svarar/отвечает/отвечают/ανταποκρίνεται/απαντά/yanıt/cevap/պատասխան*/يستجيب/استجابة/जवाब/응답/응답하지/响应/回應/応答/connecter/conectar/connettersi/verbinden/połączyć/ansluta/подключ*/соединени*/συνδεθείτε/bağlan*/միանալ/कनेक्ट/连接到/接続でき/연결할/avez suivi/suivi/seguiste/seguito/seguiu/volgde/gefolgt/kliknięt*/перешли/ακολουθήσατε/tıkladığınız/followed",
        "fortfahren/fortsetzen/weiterlesen/continuer/poursuivre/continuar/seguir/continuare/proseguire/doorgaan/kontynuować/fortsätta/продолжить/συνεχίσετε/devam/շարունակել/للمتابعة/متابعة/जारी/ለመቀጠል/գոյություն",
        "нашли/нашлось/нашл*/обнаруж*/gevonden/kunnen vinden/znaleźliśmy/hittade/bulamadık/βρήκαμε/գտանք/نجد/نعثر/encontrada/encontrado/foi encontrada/encontramos/encontrar/pudo/puede/pôde/localizad*/localiser/ubicar/zurzeit/derzeit/aktuell/momentan/actuellement/actualmente/ahora/attualmente/atualmente/momenteel/obecnie/aktualnie/just nu/för närvarande/сейчас/в данный момент/αυτή τη στιγμή/şu anda/حاليا/حاليًا/حالياً/वर्तमान/अभी/현재/目前/当前/現在/längre/meer/più/mais/more",
        "find/found/finding/exist/exists/locate/located/reach/reached/load/loaded/loading/display/displayed/show/shown/open/opening/connect/connected/access/accessed/respond/responding/process/processed/completed/serve/served/retrieve/retrieved/resolve/resolved/start/run/look for/looking for/establishing/handled/continue/occurred",
        "gefunden/finden/existiert/erreichbar/geladen/anzeigen/angezeigt/gibt es/vorhanden/laden/aufgetreten/trouv*/exist*/accéd*/charg*/affich*/produite/survenue/encontr*/cargar/mostrar/ocurrid*/producido/trovar*/trovat*/esist*/caricar*/caricat*/verificat*/carreg*/ocorreu/vinden/bestaat/geladen/weergegeven/opgetreden/znaleź*/znalezion*/istnieje/wczyta*/wyświetl*/wystąpił*/hitta*/visas/ladda*/inträffa*/bulun*/yüklen*/oluştu/tìm",
        "найти/найден*/существу*/загруз*/открыть/отобраз*/произошл*/произошел/возникл*/βρέθηκε/βρεθεί/βρούμε/υπάρχει/φόρτωσ*/φορτωθεί/παρουσιάστηκε/συνέβη/գտն*/բեռն*/առաջաց*/העמוד/العثور/موجود*/تحميل*/حدث/فتح/मिला/मिल/मिली/मौजूद/लोड/खोल/हुई/हुआ/आई/ተገኘ*/መጫን/ተከስቷል",
        "見つか/見つけ/存在/表示/利用/読み込み/読み込め/発生/接続/找到/存在/显示/顯示/加载/載入/发生/發生/찾을/존재/표시/로드/발생/พบ/โหลด/เกิด",
    ],
    # being at hand
    "offer": ["available/provided/verfügbar/disponible*/disponibil*/disponív*/beschikbaar/dostępn*/tillgänglig*/mevcut/доступ*/διαθέσιμ*/հասանելի/متاح*/متوفر*/उपलब्ध/利用可能/可用/ingen/hinterlegt/renseigné*"],
    # places, things and persons of the web
    "place": [
        "account/dein konto/konto/konta/compte/cuenta/conto/profilo/perfil/hesab*/аккаунт*/λογαριασμ*/अकाउंट/adressen/adresse/address/διεύθυνση/पता/адреса/adres/файл/archivo/fichero/plik/plik nie/fil/filen/dosya/αρχείο/फ़ाइल/ملف/documento/documentos/dokument*/document/документ*/έγγραφο/belge/दस्तावेज़/مستند/文書/文档/文件/문서/see/seen/sehen/voir/ver/vedere/vedi/zien/zobaczyć/se/увидеть/δείτε/görmek/見る/查看/보려면/المطلوبة/attempted/you tried",
        "message/messages/nachricht*/mensaje*/messaggi*/mensagem/bericht*/wiadomoś*/meddelande*/сообщени*/раздел*/материал*/μήνυμα/ενότητα/mesaj/bölüm/հաղորդագր*/رسالة/القسم/بالخادم/संदेश/अनुभाग/メッセージ/セクション/消息/메시지/artikel/artículo/articolo/artigo/artykuł/статья/статьи/άρθρο/makale/հոդված/المقال/लेख/記事/文章/기사",
        "you have been/you've been/vous avez été/has sido/ha sido/sie wurden/вы были/vous êtes",
        "you're looking for/looked for/requested page/suchen/gesuchte/gesucht/suchst/buscas/busca/buscaba/cherchez/cherchée/recherchez/cerchi/cerca/procura/procuras/zoekt/zoeken/szukasz/szukan*/söker/sökte/aradığınız/aradığın/ищете/искали/запрашиваем*/ζητήσατε/ψάχνετε/αναζητάτε/तलाश/खोज/ढूंढ*/փնտր*/የፈለጉት/찾으시/요청하신/お探し/您要找/您访问/您请求/best/nutzen/verwenden/utiliser/usar/utilizar/usare/gebruiken/korzyst*/använda/использ*/χρησιμοποι*/kullan*/यूज़/उपयोग/इस्तेमाल/استخدام/لاستخدام/利用する/使う/ご利用/使用/이용",
        "page/pages/site/website/web site/web page/webpage/url/link/address/resource/resources/file/document/content/contents/item/article/chapter/book/server/servers/server side/client side/service/services/account/connection/network/request/requests/requested/app/application/viewer/reader/player/view/read/reading/text/session/database/host/gateway/location/access/ip/your ip/reference/incident/ray id/digest/query/search/you asked for/asked for/traffic/security/feature/function/call/line/plugin/method/payload/entity/web/internet/proxy/experience/properly/correctly/function",
        "seite/seiten/webseite/website/inhalt/inhalte/inhalts/dokument/datei/adresse/anfrage/anfragen/sitzung/konto/server/dienst/text/zugriff/zugang/verbindung/lesen/anzeige/angeforderte*/gesuchte*/page/pages/site/contenu/fichier/ressource/demande/requête*/session/serveur/service/compte/texte/lien/accès/adresse/connexion/lire/voir/demandée/recherchée",
        "página*/sitio/contenido/archivo/recurso/solicitud*/sesión/servidor/servicio/cuenta/enlace/acceso/texto/dirección/conexión/ver/leer/solicitad*/buscad*/pagina/pagine/sito/contenut*/risorsa/richiesta/richieste/sessione/accesso/testo/servizio/collegamento/indirizzo/leggere/visualizzare/cercat*/conteúdo/sessão/pedido/pedidos/acesso/serviço/endereço/conta/ligação/ler/procurad*/visualizar/aceder/acessar",
        "inhoud/sessie/toegang/verzoek/verzoeken/dienst/adres/tekst/lezen/bekijken/stron*/treś*/sesj*/dostęp*/serwis*/serwer*/żąda*/adres/tekst*/konto/czyta*/zobaczy*/sida/sidan/sidor/webbplats*/innehåll*/åtkomst/sessionen/begäran/läsa/visa/sayfa*/içeri*/sunucu*/bağlantı*/erişim*/oturum*/metni/okumak/görüntüle*/trang/nội dung/máy chủ",
        "страниц*/сайт*/сервер*/сесси*/сеанс*/доступ*/запрос*/адрес*/ссылк*/содержим*/контент*/сервис*/служб*/файл*/текст*/чита*/чтени*/просм*/увидеть/аккаунт*/учетная/сторінк*/σελίδα*/σελίδας/ιστοσελίδα*/ιστότοπο*/περιεχόμενο*/σύνδεσμο*/πρόσβαση/διακομιστή*/αίτημα*/αιτήματα/συνεδρία*/κείμενο/κειμένου/διαβάσετε/δείτε/υπηρεσία/էջը/էջ/էջի/կայք*/բովանդակ*/տեքստ*/կարդալ*/մուտք*/դիմում*/העמוד/הדף/האתר/תוכן/שרת",
        "الصفحة/صفحة/الموقع/موقع/الرابط/المحتوى/محتوى/الخادم/الطلب/الطلبات/طلب*/الوصول/الجلسة/جلسة*/جلستك/النص/لعرض/عرض/قراءة/لقراءة/الاتصال/الخدمة/الحساب/حسابك/पृष्ठ/पेज/साइट/वेबसाइट/सामग्री/सर्वर/लिंक/अनुरोध/सत्र/पहुँच/पहुंच/देखने/पढ़ने/खाता/सेवा/যাচ্ছে/পৃষ্ঠা/ገጽ*/ገጹ/ገጹን/ድረ/ጽሑፍ/ለማንበብ/ለማየት/መዳረሻ",
        "ページ/サイト/サーバー/サーバ/コンテンツ/リンク/アドレス/アクセス/リクエスト/セッション/本文/サービス/ファイル/続け/読む/閲覧/ご覧/テキスト/内容/アカウント/お探し/指定/要求/页面/頁面/网页/網頁/网站/網站/本站/本页/服务器/伺服器/服务/服務/内容/內容/链接/連結/连接/地址/访问/訪問/请求/請求/会话/會話/资源/文件/阅读/閱讀/继续/繼續/查看/浏览/账号/账户/帐户/系统/登录状态/正文/페이지/사이트/서버/콘텐츠/내용/링크/주소/접근/액세스/요청/세션/연결/서비스/파일/계정/읽/보려/보기/หน้า/เว็บไซต์/เนื้อหา/เซิร์ฟเวอร์/เข้าถึง",
    ],
    # what to do about it
    "remedy": [
        "shortly/soon/will be back/back shortly/straks/gleich/einen moment/instant/instants/instantes/un instant/minuto/minutos/minuti/minute/minuten/chwil*/stund/минут*/попытк*/λίγο/biraz/थोड़ी देर/時間をおいて/一会儿/잠시/لحظات/enseguida/puis",
        "otra vez/una vez más/encore/ancora una volta/right now/nochmal/toe/eens",
        "come back/few minutes/few/completing/completing the action/action below/below/follow/volvemos/kommen sie/wieder/nach/reviens/repassez/vuelve pronto/torneremo/voltamos/wróćcie/återkom/возвращайтесь/зайдите/επιστρέψτε/ελάτε/geri/վերադարձեք/عودوا/आइए",
        "again/try/retry/retry after/reload/refresh/later/go back/return/home/homepage/home page/back/contact/administrator/webmaster/support/check/settings/restart/seconds/minutes/moment/shortly/wait/hold on/patience/client/click/press/technical team/notified/aware/working on it/fix",
        "später/erneut/nochmals/noch einmal/versuchen/versuchen sie/zurück/startseite/neu/laden sie/kehren/réessay*/plus tard/reconnect*/connect*/retour*/revenez/accueil/recharg*/ultérieurement/intent*/inténtelo/inténtalo/más tarde/de nuevo/volver/vuelva/vuelve/inicio/recarg*/actualice/riprov*/più tardi/di nuovo/torna*/ricaric*/tent*/novamente/mais tarde/volte/voltar/início/recarregue/inicie/faça",
        "probeer/opnieuw/later/terug/startpagina/meld/aan/laad/spróbuj*/ponownie/później/wróć/odśwież*/försök/igen/senare/tillbaka/ladda om/startsidan/tekrar/deneyin/sonra/giriş/dönün/yenileyin/lütfen/thử lại/sau",
        "попробу*/позже/снова/еще раз/ещё раз/вернитесь/вернуться/главн*/обновите/повторите/перезагруз*/спробуйте/δοκιμάστε/ξανά/αργότερα/επιστρ*/πάλι/ανανεώστε/կրկին/փորձ*/ավելի ուշ/վերադ*/թարմաց*/נסה/שוב",
        "حاول/المحاولة/يرجى المحاولة/لاحقا/لاحقًا/لاحقاً/مرة أخرى/العودة/عد/الرئيسية/تحديث/पुनः/फिर/दोबारा/प्रयास/कोशिश/बाद/लौट*/वापस/रीलोड/እንደገና/ቆይተው/ይሞክሩ/ተመለስ",
        "もう一度/再度/後ほど/しばらく/再読み込み/戻/ホーム/トップ/お試し/重试/重試/再试/稍后/稍後/刷新/重新/返回/首页/首頁/再次/尝试/다시/나중/시도/돌아가/홈/새로고침/잠시/ลองใหม่/อีกครั้ง/ภายหลัง/กลับ",
    ],
    # making oneself known
    "login": [
        "sign in/log in/login/log back in/sign-in/log-in/signed in/logged in/anmelden/melden sie sich an/melden sie/einloggen/eingeloggt/connectez vous/se connecter/identifiez vous/iniciar sesión/inicie sesión/inicia sesión/accedi/acced*/effettua il login/inicie sessão/iniciar sessão/inicie a sessão/faça login/entre na sua conta/meld u aan/meld je aan/inloggen/zaloguj*/zalogować/logga in/kirjaudu/giriş yapın/oturum açın/đăng nhập",
        "войдите/войти/авториз*/увійдіть/συνδεθείτε/συνδεθ*/մուտք գործ*/התחבר*/تسجيل الدخول/سجل الدخول/سجّل الدخول/लॉग इन/लॉगिन/ይግቡ",
        "ログイン/サインイン/登录/登錄/登入/로그인/เข้าสู่ระบบ",
    ],
    # something is yet to come
    "waiting": [
        "opening soon/en ligne bientôt/bientôt en ligne/new site/nouveau site/neue website/nuevo sitio/nuovo sito/novo site",
        "under development/in development/gerade gewartet/gewartet/wird überarbeitet/überarbeitet/bald/steht bald/en développement/en cours/en desarrollo/in sviluppo/em desenvolvimento/in onderhoud/w trakcie/находится в разработке/на обслуживании/ремонт*/υπό ανάπτυξη/geliştiriliyor/մշակման/تحت التطوير/विकास/開発中/开发中/개발 중",
        "coming soon/coming very soon/under construction/under maintenance/maintenance/scheduled maintenance/stay tuned/check back/back soon/be right back/launching soon/launching/content pending/pending/to be announced/parked/intentionally left blank/deliberately left blank/left blank/intentionally blank/being built/being prepared/being updated/in preparation/work in progress/in the works/not yet/yet/nothing to see here/nothing here",
        "demnächst/in kürze/im aufbau/in arbeit/in bearbeitung/wartung*/wartungsarbeiten/in vorbereitung/im bau/bientôt/prochainement/en construction/cours de construction/en travaux/maintenance/en préparation/próximamente/en construcción/en obras/mantenimiento/muy pronto/en preparación/prossimamente/in costruzione/manutenzione/in arrivo/in allestimento/presto/em breve/brevemente/em construção/manutenção/em preparação",
        "binnenkort/in aanbouw/onderhoud/in ontwikkeling/wkrótce/w budowie/w przygotowaniu/konserwac*/prace/kommer snart/under uppbyggnad/underhåll/yakında/yapım aşamasında/bakım*/hazırlanıyor/sắp ra mắt",
        "скоро/уже скоро/в разработке/на реконструкции/в стадии разработки/технические работы/технических работ/в процессе/готовится/обслуживани*/незабаром/σύντομα/έρχεται/υπό κατασκευή/συντήρηση*/σε εξέλιξη/շուտով/կառուցման/בקרוב/בבנייה",
        "قريبا/قريبًا/قريباً/قيد الإنشاء/تحت الإنشاء/قيد الانشاء/الصيانة/صيانة/قيد التطوير/قيد الإعداد/जल्द/शीघ्र/आ रहा/आने वाला/निर्माणाधीन/निर्माण/रखरखाव/तैयार/በቅርቡ/ግንባታ/በግንባታ",
        "準備中/工事中/近日公開/近日/作成中/制作中/メンテナンス/公開予定/お待ちください/敬请期待/敬請期待/即将推出/即将上线/即将/建设中/建設中/维护/維護/施工/制作中/期待/待补充/곧/준비 중/준비중/공사 중/점검/출시 예정/เร็วๆ นี้/ปรับปรุง/กำลังก่อสร้าง",
    ],
    # what a template has room for
    "noun": [
        "text/title/description/content/name/headline/heading/caption/synopsis/summary/image/picture/photo/logo/quote/bio/biography/abstract/author/body/body text/copy/paragraph/paragraphs/chapter text/subtitle/tagline/preview/information/blurb/intro",
        "text/titel/beschreibung/inhalt/bild/name/überschrift/texte/titre/contenu/nom/texto/título/descripción/contenido/nombre/imagen/testo/titolo/descrizione/contenuto/nome/immagine/descrição/conteúdo/tekst/tytuł/opis/treść/titel/beschrijving/beskrivning/rubrik/metin/başlık/açıklama",
        "текст/текста/название/заголовок/описание/содержание/имя/κείμενο/κειμένου/τίτλο/τίτλος/περιγραφή/տեքստ*/վերնագիր/նկարագր*/نص/النص/عنوان/العنوان/وصف/الوصف/اسم/पाठ/पाठ्य/टेक्स्ट/शीर्षक/विवरण/नाम/ጽሑፍ/ርዕስ/መግለጫ",
        "本文/テキスト/文章/タイトル/説明/文字/見出し/正文/文本/内容/标题/標題/描述/文字/简介/介绍/说明/텍스트/제목/설명/내용/본문/ข้อความ/ชื่อเรื่อง",
    ],
    # what is to be done in a template
    "verb": ["your text/your content/your title/your name/your description", 
        "place your/put your",
        "fügen/fügen sie/tragen sie/tragen",
        "something/write something/say something/tell/describe/your own/schreiben/schreiben sie/tragen/écrivez/décrivez/escribe/pon/scrivere/schrijf/napisz/опишите/περιγράψτε/صف/बताएं/书写/撰写/쓰세요/yourself",
        "insert/enter/add/type/write/replace/put/fill in/edit/goes/goes here/comes/click to edit/to follow/to come/paste/lorem/ipsum/einfügen/eingeben/ergänzen/folgt/ersetzen/hinzufügen/insérer/insérez/saisir/saisissez/à compléter/à venir/à remplir/remplacez/ajoutez/inserte/insertar/introduzca/escriba/añada/ingrese/agregue/inserire/inserisci/scrivi/aggiungi/insira/inserir/escreva/digite/adicione",
        "voeg/invoegen/voer/toevoegen/wstaw/wpisz/dodaj/wprowadź/infoga/skriv/lägg till/ekleyin/girin/yazın/введите/вставьте/добавьте/напишите/вставить/будет/должен быть/появится/ваш/εισαγάγετε/προσθέστε/γράψτε/մուտքագրեք/ավելացրեք/أدخل/اكتب/أضف/ضع/लिखें/डालें/जोड़ें/दर्ज करें/आएगा/ያስገቡ/ይጻፉ",
        "入力/挿入/記入/追加/填写/填寫/输入/輸入/插入/添加/待补充/입력/추가/삽입/작성/ใส่/พิมพ์",
    ],
    # what stands for something
    "stand_in_for": [
        "fixme/tbd/placeholder/placeholders/dummy/sample/example text/filler/lorem ipsum/template/untitled/beispieltext/platzhalter*/mustertext/blindtext/texte d'exemple/d'exemple/faux texte/texto de ejemplo/de ejemplo/de muestra/de relleno/testo di esempio/segnaposto/texto de exemplo/de exemplo/voorbeeldtekst/przykładowy/exempeltext/örnek/пример/образец/пример текста/δείγμα/παράδειγμα/օրինակ*/تجريبي/مؤقت/للتعبئة/नमूना/उदाहरण/ናሙና",
        "サンプル/ダミー/仮の/示例/占位/样本/範例/예시/샘플/더미/ตัวอย่าง",
    ],
    "here": ["here/your/hier/ici/votre/aquí/aqui/su/sua/qui/tuo/hier in/uw/tutaj/twój/här/din/ditt/buraya/здесь/сюда/тут/ваш/εδώ/այստեղ/هنا/यहाँ/यहां/እዚህ/ここ/此处/此處/在此/这里/這裡/여기/ที่นี่"],
}
#: Nouns of the web that make a line worth a look.
WEB = "account/konto/compte/cuenta/conto/file/datei/fichier/archivo/plik/файл/documento/dokument/document/документ/сторінк*/文档/문서/文書/服务器/サーバ/서버/الخادم/सर्वर/διακομιστής/sunucu/servern/serwer/servidor/serveur/search/page/webpage/website/site/web site/url/link/server/request/webseite/seite/seiten/adresse/inhalt/página/páginas/sitio/enlace/solicitud/pagina/sito/richiesta/pedido/strona/strony/żądan*/sida/sidan/begäran/sayfa/sayfası/страниц*/сайт*/ссылк*/запрос*/сервер*/σελίδα/σελίδας/ιστοσελίδα/αίτημα/πρόσβαση/էջ/էջը/կայք*/الصفحة/صفحة/الموقع/الرابط/الطلب/पृष्ठ/पेज/साइट/वेबसाइट/अनुरोध/ገጽ*/ገጹ/ページ/サイト/サーバー/リクエスト/页面/頁面/网页/網頁/网站/網站/请求/페이지/사이트/요청/captcha/text/titel/texte/titre/texto/título/testo/titolo/tekst/текст/κείμενο/տեքստ*/النص/पाठ/テキスト/本文/文本".split("/")
TERMS: dict[str, list[str]] = {k: sorted({w for line in v for w in line.split("/") if w}) for k, v in _W.items()}
#: Words that say nothing of what a line is about.
NEUTRAL: list[str] = sorted(
    set(
        (
            "the a an of to in into on onto for and or is are be was were been being this that these those it its we you your i us our me my has have had having please sorry with by at from as but if so do does did will would can could may might should just still then than them they their there some any all most very now currently only also after before during while until when what which who how because due our's s t re ve ll m d let let's thank thanks once more yes seem seems appears looks like order use using used about out up get got want trying tried able maybe either way one  where there's via per minute soon unfortunately hmm hello welcome dear having todo note under side part end "
            "der die das den dem des ein eine einen einem einer und oder ist sind war wird werden wurde wurden sie ihr ihre ihren ihrem ihnen wir uns um zu zur zum im am mit von für auf aus bei diese dieser dieses diesem hat haben bitte es dass konnte kann können möchten entschuldigung tut leid noch als etwas wegen weil da leider uns ihrem unsere unser unserer wenn nur jetzt gerade steht "
            "le la les un une des du de d l et ou est sont a été être ce cette ces il elle nous vous votre vos pour par sur avec dans en au aux que qui se s' c'est n' y désolé désolée veuillez merci bien avoir ont cette "
            "el los las una unos del y o es son fue ha han sido este esta esto estos estas lo le se su sus nos usted por para con en al que favor sentimos lo siento disculpe debe para tiene tu nuestro nuestra usted ahora "
            "il lo gli una dello della dei delle degli e è sono stata stato stati questo questa questi si ci vi per con su nel nella al alla che favore spiacenti scusa devi deve può "
            "o os as um uma do da dos das no na nos nas é são foi foram está estão este esta isto se por para com ao à que favor lamentamos desculpe você tem seu sua sua tu teu nós nosso nossa agora pode deve que "
            "het een van en of is zijn was werd wordt deze dit dat u uw je we ons om te in op met voor door bij er kan sorry helaas moet "
            "i oraz jest są był była została zostały ta ten to te ci w na z do o od dla przez przepraszamy proszę aby się twoja twój twoje musisz której którą którego który swojej "
            "och eller är var den det denna detta en ett av för att med på i vi du din ditt er vänligen tyvärr måste kan har som din ditt vår "
            "ve veya bir bu şu için ile da de olarak lütfen üzgünüz daha bize size "
            "и или в во на с со по для к ко из от это этот эта эту эти вы вас ваш ваша ваше мы нас было была был будет чтобы пожалуйста извините к сожалению у о за при что как может такую такая такой эту которую который вы ваши нам работы "
            "και ή το τα ο η οι των του της τον την στο στη στην στον για με από σε σας μας να είναι έχει αυτή αυτό που παρακαλώ λυπούμαστε συγγνώμη θα πρέπει "
            "و أو في من على إلى عن هذا هذه التي الذي ما قد كان تم أن إن يرجى الرجاء من فضلك نأسف عذرا عذراً عذرًا قيد آسف آسفون كنت تبحث عنها بك لديك هو هي ل ب "
            "और या का की के को में से पर यह वह इस है हैं था थी हो कर करें करने करना कृपया क्षमा खेद आप आपका आपकी हम लिए गया गई रहा रही ने कि भी साथ जा एक कुछ जो वह रहे आपके हमें हमारी हमारा ताकि अब दें दे "
            "և է են այս որ համար խնդրում ենք ցավոք ունի եք ի ու եղել ነው ናቸው እና ወይም ይህ ይህን እባክዎ እባክዎን ይቅርታ "
            "ただいま 只今 です ます した して する さい ください ませ でした ございます 申し訳 お ご この その あの ため また は が を に の へ と で も から まで れ ら な い て た さ き く り う あ え ず 的 了 请 請 抱歉 您 你 我们 我們 是 在 后 後 以 于 已 被 将 这 這 该 該 此 很 有 和 与 和 中 吧 呢 本 再 请先 先 의 이 가 을 를 은 는 에 에서 와 과 도 로 으로 하 합니다 하세요 하십시오 해주세요 해 주세요 습니다 입니다 되었습니다 되어 있습니다 있 수 죄송합니다 려면 야 주 해야 해야합니다 수가 ครับ ค่ะ กรุณา โปรด ขออภัย นี้ ของ"
        ).split()
    )
)
