"""Pattern lists of the older stand-alone detectors, scanned as a second database."""

from __future__ import annotations

# Published detection patterns. Columns: detector, regex, flags, severity, confidence, label, extract_group.
PATTERNS = [
    ('hidden-html', r'''<[^>]+style\s*=\s*["'][^"']*display\s*:\s*none[^"']*["'][^>]*>([\s\S]*?)</[^>]+>''', 'gi', 'high', 0.85, 'CSS display:none hiding content', 0),
    ('hidden-html', r'''<[^>]+style\s*=\s*["'][^"']*visibility\s*:\s*hidden[^"']*["'][^>]*>([\s\S]*?)</[^>]+>''', 'gi', 'high', 0.85, 'CSS visibility:hidden hiding content', 0),
    ('hidden-html', r'''<[^>]+style\s*=\s*["'][^"']*(?:left|top|right|bottom)\s*:\s*-\d{3,}px[^"']*["'][^>]*>([\s\S]*?)</[^>]+>''', 'gi', 'high', 0.8, 'Off-screen positioning hiding content', 0),
    ('hidden-html', r'''<[^>]+style\s*=\s*["'][^"']*(?:font-size\s*:\s*0|width\s*:\s*0|height\s*:\s*0)[^"']*["'][^>]*>([\s\S]*?)</[^>]+>''', 'gi', 'medium', 0.7, 'Zero-size element hiding content', 0),
    ('hidden-html', r'''<[^>]+style\s*=\s*["'][^"']*opacity\s*:\s*0[^"']*["'][^>]*>([\s\S]*?)</[^>]+>''', 'gi', 'medium', 0.7, 'Opacity:0 hiding content', 0),
    ('hidden-html', r'''<[^>]+style\s*=\s*["'][^"']*overflow\s*:\s*hidden[^"']*(?:max-height|max-width)\s*:\s*[01]px[^"']*["'][^>]*>([\s\S]*?)</[^>]+>''', 'gi', 'medium', 0.65, 'Overflow-hidden micro container', 0),
    ('hidden-html', r'''<[^>]+style\s*=\s*["'][^"']*color\s*:\s*(white|#fff(?:fff)?|rgba?\(\s*255)[^"']*["'][^>]*>([\s\S]*?)</[^>]+>''', 'gi', 'medium', 0.5, 'Possible background-matching text color', 0),
    ('metadata-injection', r'<!--([\s\S]*?)-->', 'g', 'high', 0.4, 'HTML comment', 0),
    ('metadata-injection', r'''aria-label\s*=\s*["']([^"']{50,})["']''', 'gi', 'high', 0.6, 'Suspicious aria-label content', 0),
    ('metadata-injection', r'''alt\s*=\s*["']([^"']{80,})["']''', 'gi', 'medium', 0.4, 'Suspicious alt text', 0),
    ('metadata-injection', r'''<meta\s+[^>]*content\s*=\s*["']([^"']{50,})["'][^>]*>''', 'gi', 'medium', 0.4, 'Meta tag content', 0),
    ('metadata-injection', r'''data-[\w-]+\s*=\s*["']([^"']{80,})["']''', 'gi', 'medium', 0.5, 'Suspicious data attribute', 0),
    ('metadata-injection', r'''title\s*=\s*["']([^"']{80,})["']''', 'gi', 'medium', 0.4, 'Suspicious title attribute', 0),
    ('dynamic-cloaking', r'(?:navigator\.userAgent|user[\s_-]?agent)[\s\S]{0,100}(?:bot|crawl|spider|scrape|headless|phantom|puppeteer|playwright|selenium|webdriver)', 'gi', 'high', 0.75, 'User-agent bot detection', 0),
    ('dynamic-cloaking', r'(?:navigator\.webdriver|window\.webdriver|__selenium|__webdriver|callPhantom|_phantom|phantom\.callback)', 'gi', 'high', 0.8, 'Automation framework detection', 0),
    ('dynamic-cloaking', r'if\s*\([^)]*(?:isBot|is_bot|isRobot|isCrawler|isAgent|isAutomated)[^)]*\)\s*\{[\s\S]{0,500}\}', 'gi', 'high', 0.85, 'Conditional content based on bot detection', 0),
    ('dynamic-cloaking', r'(?:innerHTML|textContent|innerText)\s*=[\s\S]{0,200}(?:bot|agent|crawl|automated)', 'gi', 'medium', 0.6, 'Dynamic content modification with bot references', 0),
    ('dynamic-cloaking', r'(?:window\.chrome\s*&&\s*!window\.chrome\.runtime|navigator\.languages\.length\s*===\s*0|!navigator\.plugins\.length)', 'gi', 'medium', 0.7, 'Headless browser fingerprinting', 0),
    ('dynamic-cloaking', r'(?:performance\.now|Date\.now)[\s\S]{0,100}(?:threshold|too[\s_]?fast|bot[\s_]?detect|suspicious)', 'gi', 'medium', 0.5, 'Timing-based bot detection', 0),
    ('syntactic-masking', r'\[([^\]]{20,})\]\([^)]+\)', 'g', 'high', 0.3, 'Markdown link with long anchor text', 1),
    ('syntactic-masking', r'!\[([^\]]{30,})\]\([^)]+\)', 'g', 'medium', 0.3, 'Markdown image with long alt text', 1),
    ('syntactic-masking', r'\\(?:tiny|scriptsize|footnotesize)\s*\{([^}]+)\}', 'g', 'high', 0.6, 'LaTeX small-font text', 1),
    ('syntactic-masking', r'\\(?:textcolor|color)\s*\{(?:white|background)\}\s*\{([^}]+)\}', 'g', 'high', 0.8, 'LaTeX invisible text color', 1),
    ('syntactic-masking', r'''<(?:div|span|p)\s+[^>]*style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0)[^"']*["'][^>]*>([\s\S]*?)</(?:div|span|p)>''', 'gi', 'high', 0.85, 'Hidden HTML embedded in Markdown', 1),
    ('syntactic-masking', r'[\u200B\u200C\u200D\uFEFF]{2,}', 'g', 'medium', 0.6, 'Cluster of zero-width characters', 0),
    ('syntactic-masking', r'[\u202A-\u202E\u2066-\u2069]+[^]*?[\u202C\u2069]', 'g', 'high', 0.75, 'Unicode bidirectional override', 0),
    ('jailbreak-patterns', r'(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior|above|earlier|your)\s+(?:instructions?|rules?|guidelines?|constraints?|directives?)', 'gi', 'critical', 0.95, 'Instruction override attempt', 0),
    ('jailbreak-patterns', r'(?:^|\n)\s*(?:SYSTEM|System)\s*:\s*.{10,}', 'gm', 'critical', 0.9, 'System prompt injection', 0),
    ('jailbreak-patterns', r'(?:you are now|from now on you|act as|pretend (?:to be|you are)|roleplay as|imagine you are)\s+(?:an?\s+)?(?:unrestricted|unfiltered|uncensored|jailbroken|DAN|evil|unethical)', 'gi', 'critical', 0.95, 'Role assignment jailbreak', 0),
    ('jailbreak-patterns', r'(?:for\s+(?:educational|research|academic|security)\s+purposes?\s+only|this\s+is\s+(?:a|an)\s+(?:hypothetical|thought\s+experiment|simulation|red[\s-]?team))', 'gi', 'high', 0.7, 'Educational/hypothetical framing bypass', 0),
    ('jailbreak-patterns', r'\bD\.?A\.?N\.?\b.*(?:mode|enabled|activated|jailbreak)', 'gi', 'critical', 0.95, 'DAN jailbreak keyword', 0),
    ('jailbreak-patterns', r'(?:in\s+(?:this|a)\s+(?:fictional|alternate|hypothetical)\s+(?:world|universe|scenario|reality))\s*[,.]?\s*(?:you|there\s+are\s+no|all\s+restrictions)', 'gi', 'high', 0.8, 'Fictional context bypass', 0),
    ('jailbreak-patterns', r'(?:developer|admin|debug|maintenance|root|sudo|superuser|override)\s+mode\s+(?:enabled|activated|on|initiated)', 'gi', 'critical', 0.9, 'False privilege escalation claim', 0),
    ('jailbreak-patterns', r'(?:new\s+conversation|reset\s+context|clear\s+(?:all\s+)?(?:previous|prior)\s+(?:context|messages|history))', 'gi', 'high', 0.85, 'Context reset attempt', 0),
    ('jailbreak-patterns', r'(?:base64|atob|decode|unescape|fromCharCode)\s*\([^)]*\)', 'gi', 'medium', 0.5, 'Possible encoded instruction', 0),
    ('exfiltration', r'(?:send|transmit|post|forward|upload|exfiltrate|leak|share|deliver)\s+(?:the\s+)?(?:data|content|information|context|conversation|messages?|history|credentials?|password|token|key|secret|api[\s_-]?key|session)', 'gi', 'critical', 0.85, 'Direct data exfiltration instruction', 0),
    ('exfiltration', r'(?:webhook|callback|endpoint|receiver|collector|listener)[\s\S]{0,50}(?:https?://)', 'gi', 'high', 0.7, 'Webhook/callback exfiltration pattern', 0),
    ('exfiltration', r'(?:read|access|retrieve|get|fetch|find|locate|extract)\s+[\s\S]{0,80}(?:then|and|after\s+that)\s+(?:send|post|transmit|forward|share|deliver|upload)', 'gi', 'critical', 0.9, 'Read-then-transmit pattern', 0),
    ('exfiltration', r'(?:encode|convert|transform)\s+(?:the\s+)?(?:data|content|response|context|conversation)\s+(?:to|into|as|using)\s+(?:base64|hex|url[\s-]?encoded|json)', 'gi', 'high', 0.8, 'Data encoding for exfiltration', 0),
    ('exfiltration', r'(?:read|access|open|cat|list|find)\s+(?:the\s+)?(?:file|files|directory|folder|path)\s+(?:at|in|from)\s+[\s\S]{0,50}(?:\.env|\.ssh|credentials?|password|secret|config|token)', 'gi', 'critical', 0.9, 'Sensitive file access instruction', 0),
    ('exfiltration', r'(?:send|email|mail|forward)\s+(?:the\s+)?(?:data|content|results?|output|context|summary)\s+to\s+[\w.+-]+@[\w.-]+', 'gi', 'high', 0.8, 'Email exfiltration attempt', 0),
    ('sub-agent-spawning', r'(?:create|spawn|instantiate|launch|start|initialize|invoke|call|run)\s+(?:a\s+)?(?:new\s+)?(?:agent|sub[\s-]?agent|assistant|worker|helper|bot|process|thread|task)', 'gi', 'high', 0.7, 'Agent spawning instruction', 0),
    ('sub-agent-spawning', r'''(?:with|using)\s+(?:the\s+)?(?:system\s+)?(?:prompt|instructions?|role)\s*[=:]\s*["'`]''', 'gi', 'critical', 0.85, 'System prompt for spawned agent', 0),
    ('sub-agent-spawning', r'(?:grant|give|enable|allow|provide|add)\s+(?:the\s+)?(?:agent|assistant|it|them)\s+(?:access|permission|ability|capability)\s+to\s+(?:read|write|delete|run|browse|fetch|call)', 'gi', 'critical', 0.85, 'Tool privilege escalation request', 0),
    ('sub-agent-spawning', r'(?:delegate|forward|route|pass|hand[\s-]?off)\s+(?:this\s+)?(?:task|request|work|job)\s+to\s+', 'gi', 'high', 0.6, 'Task delegation to external service', 0),
    ('sub-agent-spawning', r'(?:spin\s+up|create)\s+(?:a\s+)?(?:critic|reviewer|validator|checker)\s+[\s\S]{0,100}(?:approve|accept|pass|allow|authorize)', 'gi', 'critical', 0.9, 'Poisoned critic agent spawning', 0),
    ('sub-agent-spawning', r'(?:add|insert|inject)\s+(?:a\s+)?(?:step|stage|phase|node)\s+(?:to|into|in)\s+(?:the\s+)?(?:pipeline|workflow|chain|graph)', 'gi', 'high', 0.75, 'Pipeline/workflow injection', 0),
]
