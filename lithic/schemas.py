"""Schemas of the fact tables and of findings, as DDL.

Every rule is a function of fact tables with these columns, wherever their rows
come from: a parsed source tree or any table that is bound to the names.
"""

IMPORT = (
    "struct<module:string,names:array<string>,bound_names:array<string>,alias:string,is_from_import:boolean,is_relative:boolean,"
    "level:int,is_type_checking:boolean,is_conditional:boolean,is_try_except:boolean,line:int,col:int>"
)
EXPORT = "struct<name:string,kind:string,line:int,col:int,decorators:array<string>,is_dunder:boolean,is_private:boolean>"
FUNCTION = "struct<name:string,kind:string,line:int,end_line:int,cyclomatic:int,cognitive:int,parameters:int,lines_of_code:int>"
CALL = "struct<name:string,line:int,col:int,has_dynamic_arg:boolean,has_format_arg:boolean>"

MODULES = (
    f"path string, package string, imports array<{IMPORT}>, exports array<{EXPORT}>, functions array<{FUNCTION}>, calls array<{CALL}>, "
    "all_list array<string>, referenced_names array<string>, accessed_attributes array<string>, noqa_lines array<int>, "
    "is_init boolean, is_main boolean, is_test boolean, is_conftest boolean, line_count int, content_hash string, "
    "classes array<string>, global_variables array<string>, docstring string"
)
TOKENS = "path string, kinds array<string>, texts array<string>, lines array<int>"

#: What a rule returns. ``seq`` orders findings that the report sorts alike.
FINDINGS = (
    "rule string, severity string, message string, file string, line int, col int, end_line int, suggestion string, "
    "fix struct<kind:string,target:string,auto_fixable:boolean>, metadata map<string,string>, seq long"
)
FIELDS = [f.strip().split(" ")[0] for f in ("rule ", "severity ", "message ", "file ", "line ", "col ", "end_line ", "suggestion ", "fix ", "metadata ", "seq ")]
