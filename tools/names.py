import re
import sys

print(" ".join(re.findall(r"^def ([a-z]\w*)\(spark, d\)", open(sys.argv[1]).read(), re.M)))
